"""What is written and shuffled stays narrow, with the same rows."""

import hashlib
import os
from decimal import Decimal

from pyspark.sql import functions as F

from twinsync import spec
from twinsync.checks import all_queries, common
from twinsync.functions.keys import number_rows, packed, unpacked
from twinsync.operators import gate
from twinsync.operators.apply import line_to_old
from twinsync.operators.filters import first_of_identifier
from twinsync.operators.state import State, merge_table
from twinsync.operators.versions import stale_updates
from twinsync.plans.migration import id_mapping
from twinsync.session import FILE_ROWS, cut

EVENTS = "seq long, entity string, event_type string, aggregate_id string, payload string"


def _events(spark):
    return spark.createDataFrame([
        (1, "CUSTOMER", "CREATED", "7", '{"CustomerId":7}'),
        (2, "INVOICE", "CREATED", "8", '{"InvoiceId":8,"customerid":" 7 "}'),
        (3, "INVOICE", "CREATED", "9", '{"InvoiceId":9,"CustomerId":6}'),
        (4, "INVOICELINE", "CREATED", "1", '{"InvoiceId":8}'),
        (5, "INVOICELINE", "CREATED", "2", None),
    ], EVENTS)


def test_gate_needs_no_payload_beside_the_parents(spark):
    events = _events(spark)
    whole = {r["seq"]: r["satisfied_by"] for r in gate.gate(events, {}).collect()}
    brief = events.withColumn("parents", gate.parents()).drop("payload")
    assert {r["seq"]: r["satisfied_by"] for r in gate.gate(brief, {}).collect()} == whole
    assert whole == {1: "known", 2: "in_batch", 3: None, 4: "in_batch", 5: "skipped"}


def test_a_batch_that_holds_nothing_is_not_written_again(spark, monkeypatch):
    events = _events(spark).where("seq <> 3")
    checked = cut(gate.hold_and_release(events, None, {}, F.lit("2024-02-01").cast("timestamp")))

    def refuse(df):
        raise AssertionError("written")

    monkeypatch.setattr(gate, "cut", refuse)
    assert gate.defer_rows(checked, {}, F.lit("2024-02-01").cast("timestamp")) is checked


def test_scratch_tables_are_written_with_zstandard(spark):
    rows = cut(spark.range(10))
    folder = rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert all(f.endswith(".zstd.parquet") for f in os.listdir(folder) if f.endswith(".parquet"))


def test_rows_are_numbered_in_the_order_of_their_digest(spark):
    rows = number_rows(spark.range(3000), F.col("id").cast("string"), "n").collect()
    order = sorted(range(3000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert {r["id"]: r["n"] for r in rows} == {i: n for n, i in enumerate(order, 1)}


def test_packed_keys_are_short_and_tell_texts_apart(spark):
    made = hashlib.md5(b"1").hexdigest()
    texts = [made, made.upper(), made[:-1], "", "é", "a-b", None, bytes.fromhex("41" * 16).decode()]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed("t").alias("p"), unpacked(packed("t")).alias("u")).collect()
    assert [r["u"] for r in rows] == texts
    assert [len(r["p"]) for r in rows if r["t"] == made] == [16]
    assert len({bytes(r["p"]) for r in rows if r["p"] is not None}) == len(texts) - 1


def test_a_state_holds_only_the_tables_that_were_read(spark, data):
    common._made.clear()
    state = common.base_state(spark, data)
    assert state["map_invoice"].count() == state["new_invoice"].count() > 0
    assert not {"old_invoice_line", "new_invoice_line"} & state.tables.keys()
    assert state.replace(old_customer=state["old_customer"])["new_invoice"] is state["new_invoice"]
    common._made.clear()


def test_lines_are_numbered_once(spark, data):
    plan = all_queries()["capture_old_line"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "row_number" not in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fates_need_no_ids_of_born_rows(spark):
    state = State(spark)
    lines = spark.createDataFrame(
        [(1, "a", "c", "l1", "i1", 5, Decimal(1), 1), (2, "b", "c", "l2", "gone", 5, Decimal(1), 1)],
        "seq long, unique_identifier string, op string, InvoiceLineId string, InvoiceId string, TrackId long, UnitPrice decimal(18,2), Quantity int")
    state = state.replace(map_invoice=spark.createDataFrame([(9, "i1", None)], spec.TABLE_SCHEMAS["map_invoice"]),
                          old_invoice=spark.createDataFrame([(9, *[None] * 8)], spec.TABLE_SCHEMAS["old_invoice"]))
    changes = line_to_old(state, lines)
    assert "Join" not in _plan(changes.outcomes) and "Join" not in _plan(changes.tables["processed_old"])
    assert [(r["seq"], r["key"], r["outcome"]) for r in changes.outcomes.orderBy("seq").collect()] == [
        (1, "l1", "applied"), (2, "l2", "dead:parent_missing")]
    assert [tuple(r)[:4] for r in changes.tables["old_invoice_line"].select("InvoiceLineId", "InvoiceId", "TrackId", "Quantity").collect()] == [(1, 9, 5, 1)]
    assert [(r["OldId"], r["NewId"]) for r in changes.tables["map_invoice_line"].collect()] == [(1, "l1")]
    twice = line_to_old(state, lines.unionByName(lines))  # each copy of a creation takes an id, the greatest one stays
    assert [r["InvoiceLineId"] for r in twice.tables["old_invoice_line"].collect()] == [2]
    assert sorted(r["key"] for r in twice.outcomes.collect()) == ["l1"] * 4 + ["l2"] * 2


def test_parents_of_lines_are_read_without_numbers(spark, data):
    plan = _plan(all_queries()["invoice_details_old"](spark, data))
    assert plan.count("concat_ws(|, cast(l_orderkey") <= 3  # the numbers, and the sizes of their buckets


def test_a_stored_table_that_only_looks_small_is_not_broadcast(spark):
    """The driver would hold a million ids and digests, which the file packs into about a megabyte."""
    mapping = id_mapping(cut(spark.range(1_000_000).select(F.col("id").alias("CustomerId"))), "customer", "CustomerId", F.lit("2024-02-01"))
    joined = spark.range(4_000_000).withColumnRenamed("id", "OldId").join(mapping.select("OldId", "NewId"), "OldId", "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    few = cut(spark.range(100).withColumnRenamed("id", "OldId"))
    assert "BroadcastHashJoin" in spark.range(4_000_000).withColumnRenamed("id", "OldId").join(few, "OldId")._jdf.queryExecution().executedPlan().toString()


def test_joins_with_an_empty_table_are_left_out(spark):
    state = State(spark)
    for name, schema in spec.TABLE_SCHEMAS.items():
        assert state[name].schema == spark.createDataFrame([], schema).schema
        assert state[name].count() == 0
    delta = spark.range(3).select(F.col("id").cast("string").alias("NewId"), F.col("id").alias("OldId"), F.lit(False).alias("_deleted"))
    merged = merge_table(state["map_customer"], delta, "NewId")
    assert "Join" not in _plan(merged)
    assert merged.count() == 3


def test_only_repeated_identifiers_are_shuffled_whole(spark):
    schema = "seq long, unique_identifier string"
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None), (None, "c")], schema)
    first = first_of_identifier(events)
    assert "Exchange" not in first._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["seq"] for r in first.collect()) == [1, 2, 3, 4]
    again = events.unionByName(spark.createDataFrame([(0, "b"), (0, "b"), (9, "a"), (None, None), (5, "c")], schema))
    kept = [(r["seq"], r["unique_identifier"]) for r in first_of_identifier(again).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (0, "b"), (0, "b"), (3, None), (4, None), (None, None), (5, "c")], key=str)


def test_only_updates_meet_the_stamps(spark):
    at = F.lit("2024-02-01").cast("timestamp")
    events = spark.createDataFrame([(1, "c", "7"), (2, "u", "7"), (5, "u", "7"), (1, "u", "8"), (1, "d", "7")], "seq long, op string, aggregate_id string")
    events = events.withColumn("event_time", at).withColumn("source_table", F.lit("t"))
    stamps = spark.createDataFrame([("t|7", 4)], "RowName string, LastSeq long").withColumn("EventTime", at)
    state = State(spark, {"row_versions": stamps})
    assert [r["seq"] for r in stale_updates(events, state).collect()] == [2]
    assert "Join" not in _plan(stale_updates(events, State(spark)))


def test_scratch_files_hold_what_one_task_reads(spark):
    rows = cut(spark.range(FILE_ROWS + 1).coalesce(1))
    assert len(rows.inputFiles()) == 2 and rows.count() == FILE_ROWS + 1


def test_changes_and_base_number_the_lines_once(spark, data):
    common._made.clear()
    base = common.base_state(spark, data)["old_invoice_line"]
    for changes in (common.line_changes(spark, data), common.new_line_changes(spark, data)):
        assert "row_number" not in _plan(changes) and "lineitem" not in _plan(changes)
    ids = {r["InvoiceLineId"] for r in common.numbered_lines(spark, data)["old_invoice_line"].collect()}
    assert ids == set(range(1, len(ids) + 1)) and {r["InvoiceLineId"] for r in base.collect()} < ids
    common._made.clear()
