"""Numbering, address equality, paging of hot parents, and report helpers."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.functions.addresses import BLANK_IS_NULL, EXACT, IGNORE_CASE, TRIM_UPPER, address_key, has_required_parts, is_empty_address
from twinsync.functions.keys import allocate_after, number_rows, surrogate_key
from twinsync.operators import mutate, views
from twinsync.operators.state import State, merge

FIVE = "a string, b string, c string, d string, e string"


def test_numbers_are_dense_and_in_hash_order(spark):
    rows = number_rows(spark.range(5000), F.col("id").cast("string"), "n").collect()
    expected = sorted(range(5000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [r["id"] for r in sorted(rows, key=lambda r: r["n"])] == expected
    assert sorted(r["n"] for r in rows) == list(range(1, 5001))


def test_allocation_follows_the_greatest_key(spark):
    used = [(spark.createDataFrame([(7,), (3,)], "k long"), "k"), (spark.createDataFrame([(9,)], "o long"), "o"),
            (spark.createDataFrame([], "p long"), "p")]
    rows = allocate_after(spark.range(3), F.col("id").cast("string"), "n", used).collect()
    assert sorted(r["n"] for r in rows) == [10, 11, 12]
    empty = allocate_after(spark.range(1), F.col("id").cast("string"), "n", used[2:]).collect()
    assert [r["n"] for r in empty] == [1]


def test_surrogate_keeps_null_apart_by_position(spark):
    rows = spark.createDataFrame([(None, "x"), ("x", None)], "p string, q string")
    keys = {r[0] for r in rows.select(surrogate_key("e", "p", "q")).collect()}
    assert len(keys) == 2


@pytest.mark.parametrize("left,right,equal", [
    (("S", "c", None, "k", "1"), ("s", "c", "", "k", "1"), {IGNORE_CASE, TRIM_UPPER, BLANK_IS_NULL}),
    ((" s", "c", None, "k", "1"), ("s", "c", None, "k", "1"), {TRIM_UPPER, BLANK_IS_NULL}),
    (("S", "c", " ", "k", "1"), ("s ", "c", None, "k", "1"), {TRIM_UPPER, BLANK_IS_NULL}),
    (("s", "c", None, "k", "1"), ("s", "c", None, "k", "1"), {EXACT, IGNORE_CASE, TRIM_UPPER, BLANK_IS_NULL}),
    (("s|c", "x", None, "k", "1"), ("s", "c|x", None, "k", "1"), set()),
    (("-", "c", None, "k", "1"), (None, "c", None, "k", "1"), set()),
    (("s", " ", None, "k", "1"), ("s", None, None, "k", "1"), {TRIM_UPPER}),
])
def test_address_modes(spark, left, right, equal):
    rows = spark.createDataFrame([left, right], FIVE)
    for mode in (EXACT, IGNORE_CASE, TRIM_UPPER, BLANK_IS_NULL):
        keys = {r[0] for r in rows.select(address_key(rows.columns, mode)).collect()}
        assert (len(keys) == 1) == (mode in equal), mode


def test_address_guards(spark):
    rows = spark.createDataFrame([("", None, "", None, ""), ("s", " ", "x", "k", "1"), ("s", "c", None, "k", None)], FIVE)
    empty = [r[0] for r in rows.select(is_empty_address(rows.columns)).collect()]
    complete = [r[0] for r in rows.select(has_required_parts(F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert (empty, complete) == ([True, False, False], [False, False, True])


def test_hot_parent_is_split_into_pages(spark):
    children = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string"))).alias("parent"),
        F.col("id").alias("child"), F.col("id").alias("x"))
    pages = views.nest_children(children, "parent", "child", ["x"], page_rows=100).collect()
    hot = [p for p in pages if p["parent"] == "hot"]
    assert {p["pages"] for p in hot} == {20} and max(len(p["children"]) for p in hot) < 200
    assert sorted(c["child"] for p in pages for c in p["children"]) == list(range(6000))


def test_random_column_is_stable_and_in_range(spark):
    rows = spark.range(100).select(F.lit(1).alias("a"))
    first, second = (mutate.add_random_decimal(rows, "v", 2, seed=7).collect() for _ in range(2))
    assert first == second and all(0 <= r["v"] <= 100 for r in first) and len({r["v"] for r in first}) > 50


def test_delete_keeps_a_shared_address(spark):
    t = lambda n, rows: spark.createDataFrame(rows, spec.TABLE_SCHEMAS[n])
    state = State(spark, {
        "new_address": t("new_address", [(a, "s", "c", None, "k", None) for a in ("shared", "own", "billed")]),
        "new_customer": t("new_customer", [("1", "f", "l", "shared", None, None), ("2", "f", "l", "own", None, None),
                                           ("3", "f", "l", "shared", None, None), ("4", "f", "l", "billed", None, None)]),
        "new_invoice": t("new_invoice", [("i1", "1", None, "own", Decimal(1), Decimal(0)), ("i3", "3", None, "billed", Decimal(1), Decimal(0))]),
        "new_invoice_line": t("new_invoice_line", [("l1", "i1", 1, Decimal(1), 1), ("l3", "i3", 1, Decimal(1), 1)]),
    })
    chosen = spark.createDataFrame([("1",), ("2",), ("4",)], "CustomerId string")
    preview = {r["CustomerId"]: (r["invoices"], r["address_shared"]) for r in views.delete_preview(state, chosen).collect()}
    assert preview == {"1": (1, True), "2": (0, False), "4": (0, False)}
    after = merge(state, views.delete_customers(state, chosen, spec.NEW))
    left = {n: {r[0] for r in after[n].collect()} for n in ("new_address", "new_customer", "new_invoice", "new_invoice_line")}
    assert left == {"new_address": {"shared", "billed"}, "new_customer": {"3"}, "new_invoice": {"i3"}, "new_invoice_line": {"l3"}}
