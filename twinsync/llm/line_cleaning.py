"""Line-first cleaning: lines that break a rule go, then documents that lost too much text.

Only DataFrame functions, row by row, without a shuffle.  A line with a word fails when

* punctuation: it does not end like a sentence, or most of its words end in runs of marks;
* navigation: its words stand between separators, a few at a time;
* boilerplate: it is short and holds one of the usual notices.

Before that every document is measured.  Words are runs without blanks, tabs and line ends.
A document fails at the base with fewer than ``MIN_WORDS`` words, or when over
``MAX_REPEATED`` percent of them lie in windows of five words that it holds twice.  Windows are
compared by hash first, and by their words where hashes are equal, so counts are exact.

Null texts have no words and fail at the base, like empty ones.  Rows are judged one by one, so
repeated rows and ties get the same answer each; an empty table gives no rows; other columns are
ignored, whatever their names.  One text has to fit into a task's memory, a few times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEATED = 20
WINDOW = 5
#: A document that loses more than this percent of its characters in words with its failed lines is rejected.
MAX_LOST = 50

# Blanks between words, symbols that are counted, and what the rules look for.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""
MARKS = r"[!?#*$%&~=_]{2}"
MARKED_WORD = r"[!?#*$%&~=_]{2}$"
SEPARATOR = r"[|»›•·→]"
SEPARATOR_WORD = r"^[|»›•·→]$"
WORDS_BETWEEN = 4
SHORT_LINE = 200
NOTICES = [
    "all rights reserved", "licensed under", "released under the", "privacy policy", "cookie policy", "terms of use",
    "terms of service", "terms and conditions", "click here", "read more", "sign in", "log in", "sign up",
    "skip to content", "back to top", "enable javascript", "subscribe to our",
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def characters(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(text, BLANKS, ""))


def line_fails(line: Column) -> Column:
    """A line with a word breaks a rule; the costly parts are asked only where a cheap one allows it."""
    def many(mark: str, least: Column | int) -> Column:
        return F.size(F.filter(words(line), lambda w: w.rlike(mark))) >= least

    n = F.size(words(line))
    marked = line.rlike(MARKS) & many(MARKED_WORD, F.floor(n / 2) + 1)
    separators = F.size(F.filter(words(line), lambda w: w.rlike(SEPARATOR_WORD)))
    menu = line.rlike(SEPARATOR) & (separators >= 2) & (n <= separators + WORDS_BETWEEN * (separators + 1))
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    notice = (F.length(line) <= SHORT_LINE) & low.rlike("|".join(NOTICES))
    return ~line.rlike(SENTENCE_END) | marked | menu | notice


def _neighbours(ordered: str, value: str) -> Column:
    """Positions (``at``) in a sorted array of structs whose ``value`` also stands beside them."""
    def same(x: Column, i: Column) -> Column:
        before, after = F.get(ordered, i - 1)[value], F.get(ordered, i + 1)[value]
        return F.when((x[value] == before) | (x[value] == after), x["at"])
    return F.filter(F.transform(ordered, same), lambda at: at.isNotNull())


def measure(docs: DataFrame) -> DataFrame:
    """Every document with its whole text, its counts and ``base_failed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("_words", words(F.col("text")))
    rows = rows.withColumn("n_words", F.size("_words").cast("bigint")).withColumn(
        "_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    window = F.transform(F.sequence(F.lit(0), F.size("_hash") - WINDOW), lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, window))
    # Only documents in which some hash comes twice are looked at further.
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    by_hash = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    rows = rows.withColumn("_sorted", F.when(again, by_hash)).drop("_hash", "_windows")
    rows = rows.withColumn("_likely", _neighbours("_sorted", "hash")).drop("_sorted")
    by_words = F.array_sort(F.transform("_likely", lambda at: F.struct(
        F.concat_ws(" ", *[F.get("_words", at + k) for k in range(WINDOW)]).alias("words"), at.alias("at"))))
    rows = rows.withColumn("_equal", by_words).drop("_likely", "_words")
    rows = rows.withColumn("_at", F.array_sort(_neighbours("_equal", "words"))).drop("_equal")
    covered = F.transform("_at", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - at, F.lit(WINDOW))).cast("bigint"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0).cast("bigint"))).withColumn(
        "_lines", lines)
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    return rows.select(
        "doc_id", "text", "n_words", characters(F.col("text")).cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"))


def clean(docs: DataFrame) -> DataFrame:
    """``measure`` with the lines that are left (``cleaned``), how many failed, and the verdict ``kept``."""
    empty = lambda line: ~line.rlike(r"[^\x20\x09-\x0D]")
    rows = measure(docs).withColumn("_lines", F.split("text", "\n"))
    rows = rows.withColumn("_left", F.filter("_lines", lambda line: empty(line) | ~line_fails(line)))
    rows = rows.withColumn("cleaned", F.array_join("_left", "\n")).withColumn(
        "n_failed_lines", (F.size("_lines") - F.size("_left")).cast("bigint"))
    lost = F.col("word_chars") - characters(F.col("cleaned"))
    kept = ~F.col("base_failed") & (100 * lost <= MAX_LOST * F.col("word_chars"))
    return rows.withColumn("lost_chars", lost.cast("bigint")).withColumn("kept", kept).drop("_lines", "_left")
