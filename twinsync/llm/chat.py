"""Chat formatting by perspective rotation: the dialogue once for each participant.

For every participant of a conversation the whole dialogue is rendered with that speaker as
the assistant, the others as users under their names, and system turns as they are.  The
mask holds the character spans (start, length) to learn from: the assistant's turn texts
with their end mark.  Turns are ordered by turn number (null first), then speaker, then
text; a turn repeated with the same speaker and text is rendered once.

A conversation may hold most of all rows: rows are range-sorted by conversation and place,
numbered within each task's run and moved on by the sizes of the runs before, so no task
needs a whole conversation.  Results come in pages of ``PAGE_TURNS`` turns; pages of one
perspective, one after the other, are its rendering, and spans count from the page's start.

A null role is the speaker ``unknown``, a null text is empty, a null conv_id is a conversation
of its own kind.  A conversation of system turns alone has no participant and gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsync.session import cut

PAGE_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _prefix(speaker: Column, perspective: Column) -> Column:
    role = F.when(speaker == perspective, F.lit("assistant")).when(speaker == SYSTEM, F.lit(SYSTEM)).otherwise(
        F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (0, 1, ...), speaker, text: each conversation's turns in order."""
    spark = turns.sparkSession
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.md5("text")).groupBy("conv_id", "turn", "speaker", "tie").agg(F.first("text").alias("text"))
    order = ["conv_id", "turn", "speaker", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()))
    within = runs.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("turn", "speaker", "tie")) - 1)
    sizes = runs.groupBy("conv_id", "run").agg(F.count("*").alias("n"))  # one row a task for a long conversation
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("run")) - F.col("n")).select(
        F.col("conv_id").alias("_c"), F.col("run").alias("_r"), "before")
    joined = within.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("run") == F.col("_r")))
    return joined.select("conv_id", (F.col("_n") + F.col("before")).alias("place"), "speaker", "text")


def rotate(turns: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """conv_id, perspective, page, pages, n_turns (of the page), text, mask."""
    rows = cut(numbered(turns).withColumn("page", F.floor(F.col("place") / page_turns)))
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    pages = rows.groupBy(F.col("conv_id").alias("_c")).agg((F.max("page") + 1).alias("pages"))
    cast = people.join(pages.withColumnRenamed("_c", "_d"), F.col("_c").eqNullSafe(F.col("_d"))).drop("_d")
    # Turns gather into pages first, bounded ones; then each page meets the participants.
    gathered = rows.groupBy("conv_id", "page").agg(F.sort_array(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    each = gathered.join(cast, F.col("conv_id").eqNullSafe(F.col("_c")))
    pieces = each.withColumn("turns", F.transform("turns", lambda t: F.struct(
        _prefix(t["speaker"], F.col("perspective")).alias("prefix"), F.concat(t["text"], F.lit(CLOSE)).alias("body"),
        (t["speaker"] == F.col("perspective")).alias("own"))))
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["prefix"], t["body"], F.lit("\n"))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(so_far: Column, t: Column) -> Column:
        begin = so_far["at"] + F.length(t["prefix"])
        span = F.array(F.struct(begin.alias("start"), F.length(t["body"]).alias("length")))
        return F.struct((begin + F.length(t["body"]) + 1).alias("at"),
                        F.when(t["own"], F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    return pieces.select("conv_id", "perspective", F.col("page").cast("int").alias("page"), F.col("pages").cast("int").alias("pages"),
                         F.size("turns").alias("n_turns"), text.alias("text"), F.aggregate("turns", start, step)["spans"].alias("mask"))
