"""The running synchronisation: one batch, many batches, replays and held events."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.operators import capture, counters, reconcile, versions
from twinsync.operators.apply.common import fresh_keys
from twinsync.operators.state import Changes, State, merge
from twinsync.plans.migration import MIGRATION_NAME, MigrationError, migrate_all, run_pending
from twinsync.session import cut
from twinsync.sources import logs, outbox, streams
from twinsync.sources.tables import TableStore
from twinsync.streaming.sync import SchemaSync

ADDRESS = {"Address": "s", "City": "c", "State": None, "Country": "k", "PostalCode": "1"}
BILLING = {f"Billing{k.removeprefix('Billing')}": v for k, v in ADDRESS.items()}


def event(name, kind, table, op, payload, source="old_to_new", **more):
    return json.dumps({
        "event_id": 1, "aggregate_id": payload.get("InvoiceId", payload.get("CustomerId", payload.get("AddressId"))),
        "aggregate_type": kind, "event_type": {"c": "CREATED", "u": "UPDATED", "d": "DELETED"}[op], "payload": json.dumps(payload),
        "unique_identifier": name, "created_at": 1704716412000, "__op": op, "__source_table": table, "__source_name": source, **more,
    })


def customer(name, key, op="c", first="Ann", **more):
    return event(name, "CUSTOMER", "customer_outbox", op, {"CustomerId": key, "FirstName": first, "LastName": "L", **ADDRESS, **more})


def invoice(name, key, owner, op="c", total=1.5):
    payload = {"InvoiceId": key} if op == "d" else {"InvoiceId": key, "CustomerId": owner, "InvoiceDate": "2024-01-08 12:20:12.000000", "Total": total, **BILLING}
    return event(name, "INVOICE", "invoice_outbox", op, payload)


def line(name, key, owner, op="c", quantity=1):
    return event(name, "INVOICELINE", "invoiceline_outbox", op,
                 {"InvoiceLineId": key, "InvoiceId": owner, "TrackId": 5, "UnitPrice": 0.99, "Quantity": quantity})


EVENTS = [
    line("e1", 100, 10), customer("e2", 1), invoice("e3", 10, 1), json.dumps({"source": {"snapshot": "last"}}),
    customer("e4", 2, first="Bob", Address="t"), "not json", customer("e5", 1, "u", "Anna"), line("e6", 101, 10, quantity=2),
    invoice("e7", 11, 2), line("e8", 100, 10, "u", 7), line("e9", 999, 999), invoice("e10", 11, 2, "d"), customer("e2", 1),
]


def write(spark, folder, texts, first=0):
    rows = [(t, first + i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "value string, seq bigint").coalesce(1).write.mode("append").parquet(folder)


def run(spark, root, folder, checkpoint, **options):
    sync = SchemaSync(spark, str(root), **options)
    stream = streams.merged(
        streams.file_stream(spark, f"{folder}/old", spec.OLD_TO_NEW, 1), streams.file_stream(spark, f"{folder}/new", spec.NEW_TO_OLD, 1))
    sync.start(stream, str(checkpoint), once=True).awaitTermination()
    return sync


def content(sync):
    state = sync.store.state()
    return {
        "customers": sorted(tuple(r) for r in state["new_customer"].select("CustomerId", "FirstName", "AddressId").collect()),
        "invoices": sorted(tuple(r) for r in state["new_invoice"].select("InvoiceId", "CustomerId", "Total").collect()),
        "lines": sorted(tuple(r) for r in state["new_invoice_line"].select("InvoiceLineId", "InvoiceId", "Quantity").collect()),
        "addresses": sorted(tuple(r) for r in state["new_address"].select("AddressId", "Street").collect()),
        "processed": sorted(r[0] for r in state["processed_new"].collect()),
    }


def test_one_batch_or_many_give_the_same_tables(spark, tmp_path):
    write(spark, f"{tmp_path}/one/old", EVENTS)
    write(spark, f"{tmp_path}/one/new", [])
    single = run(spark, tmp_path / "store1", tmp_path / "one", tmp_path / "check1")
    first = content(single)
    assert {c[1] for c in first["customers"]} == {"Anna", "Bob"}
    assert len(first["invoices"]) == 1 and len(first["lines"]) == 2 and len(first["addresses"]) == 2
    assert {r[2] for r in first["lines"]} == {7, 2}
    assert single.snapshot_finished

    many = SchemaSync(spark, str(tmp_path / "store2"), compact_every=1)
    for i, start in enumerate(range(0, len(EVENTS), 7)):
        part = [(t, (start + j) * 2, spec.OLD_TO_NEW) for j, t in enumerate(EVENTS[start:start + 7])]
        many.process(spark.createDataFrame(part, "value string, seq bigint, stream string"), i)
    assert content(many) == first

    # What cannot be used is kept with its reason; the line without an invoice waits.
    dead = {r["reason"] for r in single.store.all_rows("dead_letter").collect()}
    assert dead == {"dead:bad_json"}
    assert [r["aggregate_id"] for r in single.store.read_rows("held", single.store.last_batch()).collect()] == ["999"]
    audit = single.store.audit().first()
    assert (audit["events"], audit["held"], audit["dead"]) == (13, 1, 1)


def test_replay_and_crash(spark, tmp_path):
    batch = spark.createDataFrame([(t, i * 2, spec.OLD_TO_NEW) for i, t in enumerate(EVENTS)], "value string, seq bigint, stream string")
    sync = SchemaSync(spark, str(tmp_path / "store"))

    class Stop(RuntimeError):
        pass

    def fail(*_, **__):
        raise Stop

    commit, sync.store.commit = sync.store.commit, fail
    with pytest.raises(Stop):
        sync.process(batch, 0)
    assert content(sync)["customers"] == []  # nothing counts before the audit row
    sync.store.commit = commit
    sync.process(batch, 0)
    done = content(sync)
    assert len(done["customers"]) == 2
    sync.process(batch, 0)  # the same batch again
    sync.process(batch, 1)  # the same events in a new batch: all identifiers are known
    assert content(sync) == done
    sync.store.compact()
    assert content(sync) == done
    documents = sync.store.all_rows("event_store")
    assert documents.where("batch = 0").count() == 11


def test_the_end_of_the_snapshot_is_known_after_a_restart(spark, tmp_path):
    sync = SchemaSync(spark, str(tmp_path / "store"), compact_every=1)
    marks = [[json.dumps({"source": {"snapshot": "true"}})], [json.dumps({"source": {"snapshot": "last"}})], ["not json"]]
    for i, texts in enumerate(marks):
        if i == 1:
            commit, sync.store.commit = sync.store.commit, lambda *_, **__: 1 / 0
            with pytest.raises(ZeroDivisionError):
                sync.process(spark.createDataFrame([(texts[0], 2 * i, spec.OLD_TO_NEW)], "value string, seq bigint, stream string"), i)
            sync.store.commit = commit
        assert not sync.snapshot_finished or i == 2
        sync.process(spark.createDataFrame([(texts[0], 2 * i, spec.OLD_TO_NEW)], "value string, seq bigint, stream string"), i)
    assert SchemaSync(spark, str(tmp_path / "store")).snapshot_finished


def test_held_event_times_out(spark, tmp_path):
    sync = SchemaSync(spark, str(tmp_path / "store"), timeout_seconds=0)
    schema = "value string, seq bigint, stream string"
    sync.process(spark.createDataFrame([(line("a", 1, 1), 0, spec.OLD_TO_NEW)], schema), 0)
    assert sync.store.read_rows("held", 0).count() == 1
    # An event is applied by the table it comes from, whatever its type says.
    odd = customer("b", 1).replace('"CUSTOMER"', '"Track"')
    sync.process(spark.createDataFrame([(odd, 2, spec.OLD_TO_NEW)], schema), 1)
    assert len(content(sync)["customers"]) == 1
    assert sync.store.read_rows("held", 1).count() == 0
    assert [r["reason"] for r in sync.store.read_rows("dead_letter", 1).collect()] == ["dead:dependency_timeout"]


def test_dead_letters_can_be_offered_again(spark, tmp_path):
    sync = SchemaSync(spark, str(tmp_path / "store"), timeout_seconds=0)
    schema = "value string, seq bigint, stream string"
    for i, text in enumerate([line("a", 1, 10), customer("b", 1), invoice("c", 10, 1)]):
        sync.process(spark.createDataFrame([(text, 2 * i, spec.OLD_TO_NEW)], schema), i)
    assert content(sync)["lines"] == []
    sync.reoffer()
    done = content(sync)
    assert len(done["lines"]) == 1
    sync.reoffer()  # the dead letter is still on record, its identifier is known
    assert content(sync) == done


def test_held_event_is_released_by_its_parent(spark, tmp_path):
    sync = SchemaSync(spark, str(tmp_path / "store"))
    schema = "value string, seq bigint, stream string"
    sync.process(spark.createDataFrame([(line("a", 1, 10), 0, spec.OLD_TO_NEW), (invoice("b", 10, 1), 2, spec.OLD_TO_NEW)], schema), 0)
    assert sync.store.read_rows("held", 0).count() == 2
    sync.process(spark.createDataFrame([(customer("c", 1), 4, spec.OLD_TO_NEW)], schema), 1)
    assert len(content(sync)["lines"]) == 1 and sync.store.read_rows("held", 1).count() == 0


HELD = [[customer("a", 1), invoice("b", 10, 1)], [invoice("c", 10, 2, "u", 5)], [invoice("d", 10, 1, "u", 9)], [customer("e", 2)]]


@pytest.mark.parametrize("parts", [[1, 2, 3], [2, 3]])
def test_a_held_update_does_not_overwrite_newer_ones(spark, tmp_path, parts):
    """Invoice 10 moves to a customer who comes later, and back: however the stream is cut, the last image stays."""
    sync = SchemaSync(spark, str(tmp_path / "store"))
    batches = [sum(HELD[a:b], []) for a, b in zip([0, *parts], [*parts, 4])]
    done = 0
    for i, texts in enumerate(batches):
        rows = [(t, 2 * (done + j), spec.OLD_TO_NEW) for j, t in enumerate(texts)]
        sync.process(spark.createDataFrame(rows, "value string, seq bigint, stream string"), i)
        done += len(texts)
    state = sync.store.state()
    old = {r["NewId"]: r["OldId"] for r in state["map_customer"].collect()}
    assert [(old[r["CustomerId"]], r["Total"]) for r in state["new_invoice"].collect()] == [(1, Decimal("9.00"))]
    assert sync.store.read_rows("held", sync.store.last_batch()).count() == 0


def _at(text, seconds):
    return text.replace("1704716412000", str(1704716412000 + 1000 * seconds))


LATE = [customer("a", 1), customer("b", 2, first="Bob", Address="t"), invoice("c", 10, 1), _at(invoice("d", 10, 2, "u", 9), 20),
        _at(invoice("e", 10, 1, "u", 5), 10), _at(customer("f", 1, "u", "Anna"), 30), _at(customer("g", 1, "u", "Anne"), 15)]


@pytest.mark.parametrize("parts", [[], [4], [4, 5, 6], [3, 6]])
def test_the_newest_image_by_time_stays(spark, tmp_path, parts):
    """Older updates come late over another partition, in the newer one's batch or after it."""
    sync = SchemaSync(spark, str(tmp_path / "store"), compact_every=2)
    for i, (a, b) in enumerate(zip([0, *parts], [*parts, len(LATE)])):
        rows = [(t, 2 * (a + j), spec.OLD_TO_NEW) for j, t in enumerate(LATE[a:b])]
        sync.process(spark.createDataFrame(rows, "value string, seq bigint, stream string"), i)
    state = sync.store.state()
    old = {r["NewId"]: r["OldId"] for r in state["map_customer"].collect()}
    assert [(old[r["CustomerId"]], r["Total"]) for r in state["new_invoice"].collect()] == [(2, Decimal("9.00"))]
    assert {old[r["CustomerId"]]: r["FirstName"] for r in state["new_customer"].collect()} == {1: "Anna", 2: "Bob"}
    assert {r["RowName"] for r in state["row_versions"].collect()} == {"customer_outbox|1", "invoice_outbox|10"}


def test_an_update_offered_again_does_not_overwrite_newer_ones(spark, tmp_path):
    sync = SchemaSync(spark, str(tmp_path / "store"))
    schema = "value string, seq bigint, stream string"
    early = _at(invoice("c", 10, 1, "u", 5), 10)  # comes before the row it updates
    for i, texts in enumerate([[customer("a", 1), early], [invoice("b", 10, 1), _at(invoice("d", 10, 1, "u", 9), 20)]]):
        sync.process(spark.createDataFrame([(t, 10 * i + 2 * j, spec.OLD_TO_NEW) for j, t in enumerate(texts)], schema), i)
    assert [r["reason"] for r in sync.store.all_rows("dead_letter").collect()] == ["dead:mapping_missing"]
    sync.reoffer()
    assert [r["Total"] for r in sync.store.state()["new_invoice"].collect()] == [Decimal("9.00")]
    assert [r["outcome"] for r in sync.store.read_rows("outcomes", 2).collect()] == ["skip:stale"]


def test_events_trade_numbers_by_their_stamps(spark):
    """Against a sort of every row's events; one row has a third of them, others no id or one time."""
    rng = random.Random(3)
    rows = []
    for n in rng.sample(range(100_000), 3000):
        name = rng.choice(["hot", f"r{rng.randrange(400)}", f"R{rng.randrange(400)}", None if n % 2 else spec.MISSING_AGGREGATE_ID])
        rows.append(("t" if name == "hot" else rng.choice("tu"), name, 0 if name and name.endswith("7") else rng.randrange(50), n, f"e{n}"))
    frame = spark.createDataFrame(rows, "source_table string, aggregate_id string, at int, seq bigint, name string")
    events = cut(frame.withColumn("event_time", F.timestamp_seconds("at")))
    expected, groups = {}, {}
    for table, name, at, seq, event_name in rows:
        if name in (None, spec.MISSING_AGGREGATE_ID):
            expected[event_name] = seq
        else:
            groups.setdefault((table, name.lower()), []).append((at, seq, event_name))
    for group in groups.values():
        expected |= {e[2]: n for e, n in zip(sorted(group), sorted(e[1] for e in group))}
    assert {r["name"]: r["seq"] for r in versions.in_order(events).collect()} == expected
    assert versions.in_order(events.limit(0)).count() == 0


def test_no_event_is_dropped_for_its_age_and_repeats_are(spark, tmp_path):
    sync = SchemaSync(spark, str(tmp_path / "store"))
    schema = "value string, seq bigint, stream string"
    late = customer("b", 2).replace("1704716412000", "1704715812000")  # ten minutes before the others
    for i, texts in enumerate([[customer("a", 1)], [late, customer("a", 1)]]):
        sync.process(spark.createDataFrame([(t, 10 * i + 2 * j, spec.OLD_TO_NEW) for j, t in enumerate(texts)], schema), i)
    assert len(content(sync)["customers"]) == 2


MOVES = [
    [customer("a", 1), customer("b", 2, first="Bob", Address="t"), invoice("c", 10, 1), invoice("d", 11, 1), line("e", 100, 10), line("f", 101, 11)],
    # 10 moves away before its customer goes, 11 stays and goes too; 12 is made for a customer who is deleted in the batch.
    [invoice("g", 10, 2, "u", 2.5), customer("h", 3, first="Cid"), invoice("i", 12, 3), line("j", 102, 12), invoice("k", 12, 2, "u"),
     customer("l", 1, "d"), customer("m", 3, "d"), line("n", 100, 10, "u", 4)],
    [invoice("o", 11, 2, "u"), customer("p", 1, "u", "Ann again")],  # too late for both
]


@pytest.mark.parametrize("cuts", [[6, 10], [7, 5]])
def test_an_invoice_that_moved_before_its_customer_was_deleted_stays(spark, tmp_path, cuts):
    """The same tables for every cut of the stream; an owner's deletion takes what the owner has by then."""
    events = [t for part in MOVES for t in part]
    sync = SchemaSync(spark, str(tmp_path / "store"))
    start = 0
    for i, size in enumerate([*cuts, len(events) - sum(cuts)]):
        part = [(t, (start + j) * 2, spec.OLD_TO_NEW) for j, t in enumerate(events[start:start + size])]
        if part:
            sync.process(spark.createDataFrame(part, "value string, seq bigint, stream string"), i)
        start += size
    state = sync.store.state()
    old = {r["NewId"]: r["OldId"] for n in ("customer", "invoice", "invoice_line") for r in state[f"map_{n}"].collect()}
    assert [old[r["CustomerId"]] for r in state["new_customer"].collect()] == [2]
    assert {(old[r["InvoiceId"]], old[r["CustomerId"]], r["Total"]) for r in state["new_invoice"].collect()} == {
        (10, 2, Decimal("2.50")), (12, 2, Decimal("1.50"))}
    assert {(old[r["InvoiceLineId"]], old[r["InvoiceId"]], r["Quantity"]) for r in state["new_invoice_line"].collect()} == {(100, 10, 4), (102, 12, 1)}


def test_a_new_checkpoint_on_an_old_store_is_another_run(spark, tmp_path):
    sync = SchemaSync(spark, str(tmp_path / "store"), compact_every=1)
    schema = "value string, seq bigint, stream string"
    sync.process(spark.createDataFrame([(customer("a", 1), 0, spec.OLD_TO_NEW)], schema), 0, "first")
    sync.process(spark.createDataFrame([(customer("b", 2), 2, spec.OLD_TO_NEW)], schema), 0, "second")
    sync.process(spark.createDataFrame([(customer("c", 3), 4, spec.OLD_TO_NEW)], schema), 0, "second")  # done already
    assert len(content(sync)["customers"]) == 2


def test_bad_values_become_dead_letters(spark, tmp_path):
    sync = SchemaSync(spark, str(tmp_path / "store"))
    schema = "value string, seq bigint, stream string"
    huge = json.loads(line("l", 1, 10))
    body = json.loads(huge["payload"]) if isinstance(huge["payload"], str) else huge["payload"]
    body["Quantity"] = 3000000000
    huge["payload"] = json.dumps(body) if isinstance(huge["payload"], str) else body
    far = customer("t", 5).replace("1704716412000", "9223372036854775807")
    texts = [customer("a", 1), invoice("b", 10, 1), json.dumps(huge), far]
    sync.process(spark.createDataFrame([(t, 2 * i, spec.OLD_TO_NEW) for i, t in enumerate(texts)], schema), 0)
    dead = {r["reason"] for r in sync.store.read_rows("dead_letter", 0).collect()}
    assert dead == {"dead:bad_payload", "dead:bad_time"}
    assert len(content(sync)["customers"]) == 1 and len(content(sync)["lines"]) == 0


def test_a_row_that_returns_to_an_image_gets_new_identifiers(spark):
    schema = "CustomerId bigint, FirstName string"
    a, b = spark.createDataFrame([(1, "A")], schema), spark.createDataFrame([(1, "B")], schema)
    names = [capture.capture_old_customer(x, y, capture=str(i)).first()["unique_identifier"] for i, (x, y) in enumerate([(a, b), (b, a), (a, b)])]
    again = capture.capture_old_customer(a, b, capture="0").first()["unique_identifier"]
    assert len(set(names)) == 3 and again == names[0]


def new_customer(name, key, op="c", address="a1"):
    body = {"CustomerId": key, "FirstName": "N", "LastName": "L", "AddressId": address}
    return event(name, "CUSTOMER", "CustomerOutbox", op, body, source="new_to_old")


def test_keys_come_from_a_counter(spark, tmp_path):
    """No table is looked through for its greatest key; ranges are not given out twice and a batch done again gets its own again."""
    t = lambda n, rows: spark.createDataFrame(rows, spec.TABLE_SCHEMAS[n])
    place = ("s", "c", None, "k", "1")
    store = TableStore(spark, str(tmp_path / "store"))
    store.snapshot(State(spark, {
        "old_customer": t("old_customer", [(7, "f", "l", *place, None, None)]), "map_customer": t("map_customer", [(7, "n7", None)]),
        "new_customer": t("new_customer", [("n7", "f", "l", "a1", None, None)]), "new_address": t("new_address", [("a1", *place)]),
        "map_address": t("map_address", [("1:s|1:c|-|1:k|1:1", *place, "a1", None)]),
    }), -1)
    sync = SchemaSync(spark, str(tmp_path / "store"))

    def process(texts, number, seq, side):
        sync.process(spark.createDataFrame([(x, seq + 2 * i, side) for i, x in enumerate(texts)], "value string, seq bigint, stream string"), number)
        state = sync.store.state()
        return ({r["NewId"]: r["OldId"] for r in state["map_customer"].collect()}, {r["TableName"]: r["LastKey"] for r in state["key_counters"].collect()})

    made, counts = process([new_customer("u1", "n8"), new_customer("u2", "n9")], 0, 0, spec.NEW_TO_OLD)
    assert set(made.values()) == {7, 8, 9} and counts == {"old_customer": 9, "old_invoice": 0, "old_invoice_line": 0}
    # The greatest goes, the old side brings a key of its own; neither key is given out again.
    gone = max(made, key=made.get)
    made, counts = process([new_customer("u3", gone, "d")], 1, 10, spec.NEW_TO_OLD)
    made, counts = process([customer("u4", 50)], 2, 20, spec.OLD_TO_NEW)
    assert counts["old_customer"] == 50
    commit, sync.store.commit = sync.store.commit, None
    with pytest.raises(TypeError):
        process([new_customer("u5", "n10"), new_customer("u6", "n11")], 3, 30, spec.NEW_TO_OLD)
    sync.store.commit = commit
    made, counts = process([new_customer("u5", "n10"), new_customer("u6", "n11")], 3, 30, spec.NEW_TO_OLD)
    assert {made["n10"], made["n11"]} == {51, 52} and counts["old_customer"] == 52
    # The plan of the allocation reads neither the table nor its mapping.
    state = counters.opened(sync.store.state())
    life = spark.createDataFrame([("k", "applied", "c")], "key string, outcome string, op string")
    plan = fresh_keys(life, state, spec.CUSTOMER)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower()
    assert "parquet" in fresh_keys(life, sync.store.state(), spec.CUSTOMER)._jdf.queryExecution().executedPlan().toString().lower()


# Round trip ------------------------------------------------------------------------------------


def old_side(spark):
    t = lambda n, rows: spark.createDataFrame(rows, spec.TABLE_SCHEMAS[n])
    a, b = ("s", "c", None, "k", "1"), ("t", "c", "x", "k", None)
    return State(spark, {
        "old_customer": t("old_customer", [(1, "f1", "l", *a, None, "e1"), (2, "f2", "l", *b, "p", None), (3, "f3", "l", "S", *a[1:], None, None)]),
        "old_invoice": t("old_invoice", [(10, 1, None, *a, Decimal("1.50")), (11, 2, None, *b, Decimal("2.50"))]),
        "old_invoice_line": t("old_invoice_line", [(100, 10, 5, Decimal("0.99"), 1), (101, 11, 6, Decimal("1.99"), 2)]),
    })


def as_stream(captured, table, source):
    """Outbox rows as the change topic would deliver them."""
    made = []
    for rows in captured:
        made += [json.dumps({**r.asDict(), "created_at": 1704716412000, "__op": {"C": "c", "U": "u", "D": "d"}[r["event_type"][0]],
                             "__source_table": table[r["aggregate_type"]], "__source_name": source}) for r in rows.collect()]
    return made


def test_capture_apply_reconcile(spark, tmp_path):
    state = migrate_all(old_side(spark))
    assert state["new_address"].count() == 2  # spellings that differ in case only are one address
    store = TableStore(spark, str(tmp_path / "store"))
    store.snapshot(state, -1)
    after_customer = state["old_customer"].where("CustomerId <> 2").withColumn("Phone", F.lit("new"))
    after_invoice = state["old_invoice"].where("InvoiceId <> 11").withColumn("Total", (F.col("Total") + 1).cast("decimal(18,2)"))
    added = spark.createDataFrame([(102, 10, 7, Decimal("3.00"), 3)], spec.TABLE_SCHEMAS["old_invoice_line"])
    after_line = state["old_invoice_line"].where("InvoiceId <> 11").unionByName(added)
    texts = as_stream([
        capture.capture_old_customer(state["old_customer"], after_customer),
        capture.capture_old_invoice(state["old_invoice"], after_invoice),
        capture.capture_old_line(state["old_invoice_line"], after_line),
    ], spec.OUTBOX[spec.OLD_TO_NEW], spec.OLD_TO_NEW)
    store.write_step(Changes({
        "old_customer": after_customer.withColumn("_deleted", F.lit(False)).unionByName(
            state["old_customer"].where("CustomerId = 2").withColumn("_deleted", F.lit(True))),
        "old_invoice": after_invoice.withColumn("_deleted", F.lit(False)).unionByName(
            state["old_invoice"].where("InvoiceId = 11").withColumn("_deleted", F.lit(True))),
        "old_invoice_line": added.withColumn("_deleted", F.lit(False)).unionByName(
            state["old_invoice_line"].where("InvoiceId = 11").withColumn("_deleted", F.lit(True))),
    }), 0, 0)
    store.commit(0)
    before = store.state()
    sync = SchemaSync(spark, str(tmp_path / "store"))
    sync.process(spark.createDataFrame([(t, i, spec.OLD_TO_NEW) for i, t in enumerate(texts)], "value string, seq bigint, stream string"), 1)
    after = store.state()
    # 3 shares the address row of 1, which keeps one spelling for both; nothing else differs.
    assert {(r["key"], r["column"]) for r in reconcile.all_mismatches(after).collect()} <= {("3", "Address"), ("1", "Address"), ("10", "BillingAddress")}
    assert reconcile.all_missing_rows(after).count() == 0
    # Echo: what the new side captures of these changes alters nothing on the old side.
    echoes = as_stream([
        capture.capture_new(before[f"new_{t}"], after[f"new_{t}"], e, after)
        for e, t in ((spec.ADDRESS, "address"), (spec.CUSTOMER, "customer"), (spec.INVOICE, "invoice"), (spec.LINE, "invoice_line"))
    ], spec.OUTBOX[spec.NEW_TO_OLD], spec.NEW_TO_OLD)
    kinds = {(json.loads(t)["aggregate_type"], json.loads(t)["event_type"]) for t in echoes}
    assert (spec.LINE, "CREATED") not in kinds and (spec.LINE, "DELETED") in kinds
    sync.process(spark.createDataFrame([(t, i * 2 + 1, spec.NEW_TO_OLD) for i, t in enumerate(echoes)], "value string, seq bigint, stream string"), 2)
    final = store.state()
    for name in ("old_invoice_line", "new_customer", "new_invoice", "new_invoice_line"):
        assert {tuple(r) for r in final[name].collect()} == {tuple(r) for r in after[name].collect()}, name


# Migration and sources -----------------------------------------------------------------------------


def test_ledger_runs_once(spark):
    done = run_pending(old_side(spark))
    assert [r["MigrationName"] for r in done["migration_ledger"].collect()] == [MIGRATION_NAME]
    again = run_pending(done)
    assert again["new_customer"].count() == 3 and again["migration_ledger"].count() == 1


def test_migration_stops_on_missing_parent(spark):
    state = old_side(spark)
    orphan = spark.createDataFrame([(200, 99, 1, Decimal(1), 1)], spec.TABLE_SCHEMAS["old_invoice_line"])
    with pytest.raises(MigrationError, match="new_invoice_line"):
        migrate_all(state.replace(old_invoice_line=state["old_invoice_line"].unionByName(orphan)))


def test_test_value_is_copied_on_request(spark):
    from twinsync.plans.migration import migrate_invoices
    state = migrate_all(old_side(spark))
    state = state.replace(old_invoice=state["old_invoice"].withColumn("TestValue3", F.lit(Decimal("1.234")).cast("decimal(12,3)")))
    value = lambda copy: {r["TestValue3"] for r in migrate_invoices(state, copy_test_value=copy)["new_invoice"].collect()}
    assert (value(False), value(True)) == ({Decimal("0.000")}, {Decimal("1.234")})


def test_timeline_export_and_logs(spark, tmp_path):
    rows = spark.createDataFrame(
        [(2, 7, "CUSTOMER", "CREATED", "{}", "u2", "2024-01-02 00:00:00"), (1, 7, "CUSTOMER", "CREATED", "{}", "u1", "2024-01-01 00:00:00")],
        "event_id int, aggregate_id int, aggregate_type string, event_type string, payload string, unique_identifier string, created_at string")
    for table in spec.OUTBOX[spec.OLD_TO_NEW].values():
        rows.write.parquet(f"{tmp_path}/{table}")
    captured = capture.capture_old_customer(old_side(spark)["old_customer"].where("false"), old_side(spark)["old_customer"])
    outbox.append(captured, f"{tmp_path}/captured")
    assert outbox.entries(spark.read.parquet(f"{tmp_path}/captured"), "OLD", "captured").count() == 3
    side = outbox.read_side(spark, str(tmp_path), spec.OLD_TO_NEW)
    merged = outbox.timeline(side, side.limit(0))
    outbox.export_timeline(merged, f"{tmp_path}/out")
    text = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert text[0] == "|".join(outbox.TIMELINE) and text[1].startswith("OLD|customer_outbox|1|7") and len(text) >= 7
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("12 [INF] fine\n13 [FTL] bad\nERROR 7\n")
    (tmp_path / "logs" / "b.log").write_text("[FATAL] worse\n")
    lines = logs.read_logs(spark, str(tmp_path / "logs"))
    health = logs.log_health(lines).first()
    assert (health["lines"], health["errors"], health["fatal"], health["problems"], health["healthy"]) == (4, 1, 2, 3, False)
    assert logs.fatal_lines(lines).count() == 2


def test_merge_keeps_one_row_per_key(spark):
    base = spark.createDataFrame([(1, "f", "l", "s", "c", None, "k", None, None, None)], spec.TABLE_SCHEMAS["old_customer"])
    state = State(spark, {"old_customer": base})
    delta = base.withColumn("FirstName", F.lit("g")).withColumn("_deleted", F.lit(False))
    assert [r["FirstName"] for r in merge(state, Changes({"old_customer": delta}))["old_customer"].collect()] == ["g"]
