"""URL filtering: stated host and path rules first, mined token rules for the rest.

A stated rule is a host and a path prefix; it fits the host and all its subdomains, and the
rule with the longest text wins (ties: the later in alphabetical order).  URLs that a stated
rule decides are the labels from which Spark's FP-growth mines token combinations; a rule
"tokens -> verdict" is kept when enough labelled URLs hold it (support) and enough of those
have the verdict (confidence), and no kept shorter rule says the same.  Tokens that the same
labelled URLs hold are one item, as any of them makes the same rules: a path that many URLs share
is then one item, not a combination for each choice of its segments.  An undecided URL is
matched through an inverted index: a mined rule is filed under its rarest item, URLs meet
the rules of their items, and a rule fires when the URL holds a token of each of its items.  The fired
rule with the highest confidence (then support, then block) decides; without one the URL is
allowed.

URLs are read whole, however long.  A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed.
Repeated rows are judged alike.  Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsync.llm.common import lookup_join
from twinsync.session import cut

#: (verdict, host, path): fixed values of the contract.
STATED = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SUPPORT, CONFIDENCE = 0.001, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict); null where none fits.  The list is code, so it is small."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: labels of the host, its last two labels together, segments of the path, names of the query."""
    labels = F.split(host, r"\.")
    named = F.transform(labels, lambda x: F.concat(F.lit("host:"), x))
    top = F.concat(F.lit("top:"), F.element_at(labels, -1))
    site = F.concat(F.lit("site:"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^([^=]*)", 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(named, F.array(top, site), parts, names), lambda x: ~x.endswith(":"))))


def equal_tokens(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """token, item for the tokens that enough labelled URLs hold: tokens that the same URLs hold share one item, the least of them.

    Same URLs: as many, and with equal sums of two 64-bit hashes.  Such tokens stand together in
    one URL, so no group is larger than a URL.  Rarer tokens are in no rule that has the support.
    """
    least = labelled.count() * support
    one, two = (F.xxhash64(F.lit(i), "tokens").cast("decimal(38,0)") for i in (1, 2))
    counts = labelled.select(F.explode("tokens").alias("token"), one.alias("one"), two.alias("two")).groupBy("token").agg(
        F.count("*").alias("urls"), F.sum("one").alias("one"), F.sum("two").alias("two")).where(F.col("urls") >= least)
    return counts.groupBy("urls", "one", "two").agg(F.collect_set("token").alias("all")).select(
        F.explode("all").alias("token"), F.array_min("all").alias("item"))


def with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``items``: the items that a row's ``tokens`` belong to, each with the least token held."""
    kinds = cut(rows.groupBy("tokens").agg(F.count("*").alias("_rows")))
    spread = kinds.select("tokens", F.explode("tokens").alias("token"))
    entries = cut(spread.groupBy("token").agg(F.count("*").alias("n")).join(items, "token"))
    held = lookup_join(spread, entries, "token", "n").groupBy("tokens", "item").agg(F.min("token").alias("token"))
    found = held.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("item", "token"))).alias("items"))
    none = F.array().cast("array<struct<item:string,token:string>>")
    named = cut(kinds.join(found, "tokens", "left").withColumn("items", F.coalesce("items", none)))
    return lookup_join(rows, named, "tokens", "_rows").drop("_rows")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """tokens, verdict, confidence, support of the rules that are kept; ``labelled`` has tokens and verdict.

    Combinations of tokens that always occur together are all mined: give items instead (``equal_tokens``).
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    verdict = F.element_at("consequent", 1)
    rules = model.associationRules.where(verdict.startswith("verdict=")).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(verdict, len("verdict=") + 1, 100).alias("verdict"), "confidence", "support")
    # A longer rule that a kept shorter one implies, at no lower confidence, says nothing new.  By size, so few are compared.
    rest, kept, size = cut(rules), None, 0
    while kept is None or not rest.isEmpty():
        size += 1
        own = rest.where(F.size("tokens") == size)
        kept = own if kept is None else kept.unionByName(own)
        part = own.select("verdict", F.element_at("tokens", 1).alias("token"), F.col("tokens").alias("fewer"), F.col("confidence").alias("sure"))
        rest = rest.where(F.size("tokens") > size)
        longer = rest.select("verdict", "tokens", "confidence", F.explode("tokens").alias("token"))
        same = longer.join(part, ["verdict", "token"]).where("sure >= confidence and size(array_except(fewer, tokens)) = 0")
        rest = cut(rest.join(same.select("verdict", "tokens").distinct(), ["verdict", "tokens"], "left_anti"))
    return kept


def inverted(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rules, each filed under the token of its own that the fewest labelled URLs hold."""
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("urls"))
    spread = rules.select("tokens", "verdict", "confidence", "support", F.explode("tokens").alias("token")).join(counts, "token")
    return spread.groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("urls", "token")).alias("token"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = STATED, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and, where a mined rule decided, its tokens and confidence."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens(host_of(url), path_of(url), url).alias("tokens"))
    rows = cut(parsed.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules)))
    labelled = rows.where("stated is not null").select("tokens", F.col("stated.verdict").alias("verdict"))
    out = ["page_id", "host", "path", "rule", "verdict", "mined_tokens", "confidence"]
    decided = rows.where("stated is not null").select(
        "page_id", "host", "path", "stated.rule", "stated.verdict", F.lit(None).cast("array<string>").alias("mined_tokens"),
        F.lit(None).cast("double").alias("confidence"))
    open_ = rows.where("stated is null")
    if labelled.isEmpty():
        best = None
    else:
        items = cut(equal_tokens(labelled, support))
        baskets = cut(with_items(labelled, items).select(F.col("items.item").alias("tokens"), "verdict"))
        index = cut(inverted(mine(baskets, support, confidence), baskets))
        kinds = cut(open_.groupBy("tokens").agg(F.count("*").alias("urls")))  # URLs with the same tokens are judged once
        met = with_items(kinds, items).select("tokens", "items", F.explode("items.item").alias("token")).join(
            index.withColumnRenamed("tokens", "needed"), "token")
        wanted = F.expr("array_sort(transform(filter(items, x -> array_contains(needed, x.item)), x -> x.token))")
        fired = met.where("size(array_except(needed, items.item)) = 0").withColumn("wanted", wanted)
        best = cut(kinds.join(fired.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "verdict", "wanted")).alias("best")),
                              "tokens", "left"))
    if best is None:
        judged = open_.withColumn("best", F.lit(None).cast("struct<confidence:double,support:double,verdict:string,wanted:array<string>>"))
    else:
        judged = lookup_join(open_, best, "tokens", "urls")
    mined = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                          F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.col("best.wanted").alias("mined_tokens"),
                          F.col("best.confidence").alias("confidence"))
    return decided.select(out).unionByName(mined.select(out))
