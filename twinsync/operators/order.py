"""Parents before children inside a batch.

Releasing events as their last parent is emitted, with ties in arrival order, emits
them level by level.  So an event's place is the pair (level, path): the level is one
more than its last parent's, the path is that parent's path plus the event's own
arrival number.  Pairs compare like positions, and no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.operators import classify
from twinsync.operators.classify import Groups


def foreign_id(payload: Column, field: str, ignore_case: bool = False) -> Column:
    """The id an event's payload names; the sort matches property names exactly, the gate without case."""
    if not ignore_case:
        return F.get_json_object(payload, f"$.{field}")
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))
    return F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == field.lower()), F.lit(1))["value"]


def dependency_order(
    events: DataFrame, groups: Groups = spec.PRIORITY_GROUPS, ignore_case: bool = False
) -> DataFrame:
    """Add ``place`` (level, path) and ``parents`` (how many in-batch parents) to the events of a batch.

    ``events`` has ``seq, entity, aggregate_id, payload``.  Each dependency points to the
    first event in the batch with the parent's type and id.
    """
    edges = classify.edges(groups)
    ranks = classify.levels(groups)
    first: dict[str, DataFrame] = {}
    own = F.array(F.col("seq"))
    ordered = []
    for type_ in sorted(ranks, key=ranks.get):
        mine = events.where(F.upper("entity") == type_)
        parents = []
        for i, (child, parent, field) in enumerate(edges):
            if child == type_:
                above = first[parent].select(F.col("id").alias(f"_fk{i}"), F.col("place").alias(f"_p{i}"))
                mine = mine.withColumn(f"_fk{i}", foreign_id(F.col("payload"), field, ignore_case))
                mine = mine.join(above, f"_fk{i}", "left")
                parents.append(F.col(f"_p{i}"))
        last = F.greatest(*parents) if len(parents) > 1 else parents[0] if parents else None
        count = sum((p.isNotNull().cast("int") for p in parents), F.lit(0))
        mine = mine.select(*events.columns, _place(last, own).alias("place"), count.alias("parents"))
        if any(parent == type_ for _, parent, _ in edges):
            first[type_] = mine.groupBy(F.col("aggregate_id").alias("id")).agg(F.min_by("place", "seq").alias("place"))
        ordered.append(mine)
    known = F.coalesce(F.upper("entity").isin(list(ranks)), F.lit(False))
    ordered.append(events.where(~known).select("*", _place(None, own).alias("place"), F.lit(0).alias("parents")))
    result = ordered[0]
    for part in ordered[1:]:
        result = result.unionByName(part)
    return result


def _place(last: Column | None, own: Column) -> Column:
    """Below the last parent emitted, or on the first level."""
    top = F.struct(F.lit(0).alias("level"), own.alias("path"))
    if last is None:
        return top
    below = F.struct((last["level"] + 1).alias("level"), F.concat(last["path"], own).alias("path"))
    return F.when(last.isNull(), top).otherwise(below)


def not_emitted(events: DataFrame, emitted: DataFrame) -> DataFrame:
    """Events a sort did not emit; they follow at the end in arrival order."""
    return events.join(emitted.select("seq"), "seq", "left_anti")


def sorted_batch(events: DataFrame) -> DataFrame:
    """The batch in dependency order (range-partitioned sort)."""
    return events.orderBy("place")


def batch_summary(events: DataFrame, batch: Column, per_row: int = 1000) -> DataFrame:
    """Log line of a batch: its events as ``aggregate_id:type`` in arrival order, and their number.

    Arrival numbers are unique, so ``per_row`` consecutive ones hold at most that many
    events; a batch gets as many lines as it needs and no list grows with the batch.
    """
    part = F.floor(F.col("seq") / per_row).cast("bigint")
    item = F.concat_ws(":", "aggregate_id", "entity")
    return (
        events.groupBy(batch.alias("batch"), part.alias("part"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"),
        )
        .select("batch", "part", "events", F.array_join(F.col("items.item"), ", ").alias("summary"))
    )
