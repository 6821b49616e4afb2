"""Classification, gate and order, with the known cases and against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.operators import classify
from twinsync.operators.gate import defer_rows, gate, hold_and_release
from twinsync.operators.lookup import dependency_exists, known_parents
from twinsync.operators.order import batch_summary, dependency_order, not_emitted, sorted_batch
from twinsync.operators.state import State
from twinsync.session import cut
from twinsync.spec import Dependency

EVENTS = "seq long, entity string, event_type string, aggregate_id string, payload string"


def frame(spark, *events):
    """Events as (entity, id, payload) in arrival order."""
    return spark.createDataFrame(
        [(i, e, "CREATED", str(a), json.dumps(p)) for i, (e, a, p) in enumerate(events)], EVENTS)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "dep_id string")


def verdicts(rows):
    return [r["satisfied_by"] for r in rows.orderBy("seq").collect()]


def line(invoice, id_=1):
    return ("INVOICELINE", invoice, {"InvoiceLineId": id_, "InvoiceId": invoice})


def invoice(id_, customer):
    return ("INVOICE", id_, {"InvoiceId": id_, "CustomerId": customer})


# Classification --------------------------------------------------------------------------


def test_priority_with_extra_group(spark):
    groups = [spec.PRIORITY_GROUPS[0], [Dependency("A", "Id"), Dependency("B", "Id"), Dependency("C", "Id")]]
    rows = spark.createDataFrame([("invoice",), ("InvoiceLine",), ("C",), ("Customer",)], "t string")
    group, element = classify.priority(F.col("t"), groups)
    last = spec.NO_PRIORITY
    assert [tuple(r) for r in rows.select(group, element).collect()] == [(0, 0), (0, 1), (1, 2), (last, last)]


def test_dependent_and_dependency_may_disagree(spark):
    rows = spark.createDataFrame([("Invoice",)], "t string")
    found = rows.select(classify.is_dependent(F.col("t")), classify.dependency_type(F.col("t"))).first()
    assert tuple(found) == (False, "Customer")


def test_cycle_is_refused():
    with pytest.raises(ValueError):
        classify.levels([[Dependency("A", "Id"), Dependency("B", "Id")], [Dependency("B", "Id"), Dependency("A", "Id")]])


# Gate -------------------------------------------------------------------------------------


def test_parent_in_batch_later(spark):
    batch = frame(spark, line(111), invoice(111, ""))
    assert verdicts(gate(batch, {})) == ["in_batch", "skipped"]


def test_parent_known(spark):
    assert verdicts(gate(frame(spark, line(111)), {spec.INVOICE: ids(spark, "111")})) == ["known"]


def test_parent_of_other_kind_does_not_count(spark):
    batch = frame(spark, line(417), invoice("0d640540", ""))
    assert verdicts(gate(batch, {})) == [None, "skipped"]


def test_waiting_parent_does_not_release_its_child(spark):
    batch = frame(spark, line(414), invoice(414, 60))
    assert verdicts(gate(batch, {})) == [None, None]


def test_three_levels_out_of_order(spark):
    batch = frame(spark, invoice(414, 60), line(414), ("CUSTOMER", 60, {"CustomerId": 60}))
    assert verdicts(gate(batch, {})) == ["in_batch", "in_batch", "known"]


def test_ids_match_without_case_and_blanks(spark):
    batch = frame(spark, ("InvoiceLine", 1, {"invoiceid": " AB "}), ("Invoice", "ab", {}))
    assert verdicts(gate(batch, {})) == ["in_batch", "skipped"]


def test_unknown_type_passes(spark):
    assert verdicts(gate(frame(spark, ("TRACK", 1, {})), {})) == ["no_dependency"]


def test_hold_release_and_timeout(spark):
    at = [F.lit(f"2024-01-01 00:0{m}:00").cast("timestamp") for m in (0, 1, 4)]
    first = cut(hold_and_release(frame(spark, line(1), line(2)), None, {}, at[0]))
    held = first.where("decision = 'hold'").select("seq", "entity", "event_type", "aggregate_id", "payload", "held_since")
    assert held.count() == 2
    second = spark.createDataFrame([(5, "INVOICE", "CREATED", "1", "{}")], EVENTS)
    again = cut(hold_and_release(second, held, {}, at[1]))
    assert {r["seq"]: r["decision"] for r in again.collect()} == {0: "release", 1: "hold", 5: "release"}
    still = again.where("decision = 'hold'").select(held.columns)
    last = hold_and_release(second.where("false"), still, {}, at[2])
    assert [r["decision"] for r in last.collect()] == ["dead:dependency_timeout"]


def test_later_events_of_a_held_row_wait_behind_it(spark):
    at = [F.lit(f"2024-01-01 00:0{m}:00").cast("timestamp") for m in (0, 1, 4)]
    known = {"CUSTOMER": ids(spark, "1")}
    batch = frame(spark, invoice(10, 1), invoice(10, 2), line(10, 5), invoice(10, 1), ("INVOICE", 10, {}), invoice(11, 1), invoice(12, 2), line(12), line(13),
                  invoice(13, 1))
    decisions = lambda rows: {r["seq"]: r["decision"] for r in rows.collect()}
    first = defer_rows(cut(hold_and_release(batch, None, known, at[0])), known, at[0])
    # 1 waits for customer 2; 3 and 4 are of the same row; the line of 10 finds it delivered by 0.
    assert decisions(first) == {i: "hold" if i in (1, 3, 4, 6, 7) else "release" for i in range(10)}
    held = first.where("decision = 'hold'").select(*batch.columns, "held_since")
    fresh = spark.createDataFrame([(20, "CUSTOMER", "CREATED", "3", "{}"), (21, "INVOICE", "UPDATED", "10", "{}")], EVENTS)
    second = defer_rows(cut(hold_and_release(fresh, held, known, at[1])), known, at[1])
    assert decisions(second) == {1: "hold", 3: "hold", 4: "hold", 6: "hold", 7: "hold", 20: "release", 21: "hold"}
    held = second.where("decision = 'hold'").select(*batch.columns, "held_since")
    # The first one's time is over: what waited behind it goes, and has no time limit of its own.
    last = defer_rows(cut(hold_and_release(fresh.where("false"), held, known, at[2])), known, at[2])
    assert decisions(last) == {1: "dead:dependency_timeout", 3: "release", 4: "release", 21: "release", 6: "dead:dependency_timeout",
                               7: "dead:dependency_timeout"}


def test_a_deferred_row_delivers_no_parent(spark):
    """Customer 7 is asked for by invoice 20, but its only ready event waits behind one that names an unknown address."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = [("CUSTOMER", 7, {"AddressId": "a9"}), ("CUSTOMER", 7, {"AddressId": ""}), invoice(20, 7), invoice(20, 8), line(20), invoice(21, 8)]
    batch = frame(spark, *rows).withColumn("event_type", F.lit("UPDATED"))
    known = {"ADDRESS": ids(spark, "a1"), "CUSTOMER": ids(spark, "8")}
    found = defer_rows(cut(hold_and_release(batch, None, known, at)), known, at)
    assert {r["seq"]: r["decision"] for r in found.collect()} == {0: "hold", 1: "hold", 2: "hold", 3: "hold", 4: "hold", 5: "release"}


def brute_gate(events, known):
    edges = classify.edges()
    ready = set()
    while True:
        added = False
        for seq, (entity, _, payload) in enumerate(events):
            if seq in ready:
                continue
            ok = True
            for child, parent, field in edges:
                if child == entity:
                    dep = str(payload.get(field, ""))
                    if entity == "CUSTOMER":
                        dep = "CREATE_NEW_ADDRESS"
                    delivered = any(events[s][0] == parent and str(events[s][1]) == dep for s in ready)
                    ok &= dep in ("", "CREATE_NEW_ADDRESS") or dep in known.get(parent, ()) or delivered
            if ok:
                ready.add(seq)
                added = True
        if not added:
            return ready


def random_events(rng, n):
    made = []
    for _ in range(n):
        kind = rng.choice(["CUSTOMER", "INVOICE", "INVOICE", "INVOICELINE", "INVOICELINE"])
        key = rng.randrange(6)
        if kind == "CUSTOMER":
            made.append((kind, key, {"CustomerId": key}))
        elif kind == "INVOICE":
            made.append(invoice(key, rng.randrange(6)))
        else:
            made.append(line(key, rng.randrange(100)))
    return made


@pytest.mark.parametrize("seed", range(4))
def test_gate_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    events = random_events(rng, 25)
    known = {spec.CUSTOMER: ["0"], spec.INVOICE: ["1", "2"]}
    rows = gate(frame(spark, *events), {k: ids(spark, *v) for k, v in known.items()})
    ready = {r["seq"] for r in rows.where("satisfied_by is not null").collect()}
    assert ready == brute_gate(events, known)


# Order --------------------------------------------------------------------------------------


def queue_order(events):
    """Release events as their last parent is emitted, first in first out."""
    parents = []
    for entity, _, payload in events:
        mine = []
        for child, parent, field in classify.edges():
            if child == entity and payload.get(field) is not None:
                hit = next((s for s, e in enumerate(events) if e[0] == parent and str(e[1]) == str(payload[field])), None)
                if hit is not None:
                    mine.append(hit)
        parents.append(mine)
    left = [len(p) for p in parents]
    queue = [s for s, n in enumerate(left) if n == 0]
    for seq in queue:
        for child, above in enumerate(parents):
            left[child] -= above.count(seq)
            if seq in above and left[child] == 0:
                queue.append(child)
    return queue


@pytest.mark.parametrize("seed", range(6))
def test_order_equals_queue(spark, seed):
    events = random_events(random.Random(seed), 30)
    ordered = sorted_batch(dependency_order(frame(spark, *events)))
    assert [r["seq"] for r in ordered.collect()] == queue_order(events)


def test_parent_first_despite_arrival(spark):
    batch = frame(spark, line(496), invoice(496, 1))
    assert [r["seq"] for r in sorted_batch(dependency_order(batch)).collect()] == [1, 0]


def test_property_case_matters_in_the_sort_only(spark):
    batch = frame(spark, ("INVOICELINE", 1, {"invoiceid": 1}), ("INVOICE", 1, {}))
    strict, lenient = dependency_order(batch), dependency_order(batch, ignore_case=True)
    assert [r["seq"] for r in sorted_batch(strict).collect()] == [0, 1]
    assert [r["seq"] for r in sorted_batch(lenient).collect()] == [1, 0]


def test_not_emitted(spark):
    batch = frame(spark, line(1), line(2), line(3))
    assert [r["seq"] for r in not_emitted(batch, batch.where("seq = 1")).orderBy("seq").collect()] == [0, 2]


def test_batch_summary_parts(spark):
    rows = batch_summary(frame(spark, line(1), line(2), line(3)), F.lit(7), per_row=2).orderBy("part").collect()
    assert [(r["part"], r["events"], r["summary"]) for r in rows] == [(0, 2, "1:INVOICELINE, 2:INVOICELINE"), (1, 1, "3:INVOICELINE")]


# Existence ------------------------------------------------------------------------------------


def test_existence_by_direction(spark):
    exact = lambda *p: "|".join("-" if x is None else f"{len(x)}:{x}" for x in p)
    state = State(spark, {
        "map_customer": spark.createDataFrame([(1, "n1", None)], spec.TABLE_SCHEMAS["map_customer"]),
        "map_address": spark.createDataFrame(
            [(exact("s", "c", None, "k", None), "s", "c", None, "k", None, "a1", None)], spec.TABLE_SCHEMAS["map_address"]),
        "old_customer": spark.createDataFrame(
            [(1, "x", "y", "s", "c", None, "k", None, None, None), (2, "x", "y", "s", "c", "", "k", None, None, None)],
            spec.TABLE_SCHEMAS["old_customer"]),
        "old_invoice": spark.createDataFrame(
            [(2, 1, None, "s", "c", None, "k", None, None), (3, 1, None, "s", "c", None, "k", None, None)],
            spec.TABLE_SCHEMAS["old_invoice"]),
    })

    def found(source, parent, *wanted):
        rows = dependency_exists(ids(spark, *wanted), state, source, parent)
        return {r["dep_id"] for r in rows.collect()}

    assert found(spec.OLD_TO_NEW, spec.CUSTOMER, "1", "n1", "CREATE_NEW_ADDRESS") == {"1", "CREATE_NEW_ADDRESS"}
    assert found(spec.NEW_TO_OLD, spec.CUSTOMER, "1", "n1") == {"n1"}
    assert found(spec.NEW_TO_OLD, spec.ADDRESS, "a1", "a2") == {"a1"}
    # 2 is a customer with another address, so it is not looked up as an invoice; 3 is an invoice.
    assert found(spec.OLD_TO_NEW, spec.ADDRESS, "1", "2", "3", "4") == {"1", "3"}
    assert found(spec.OLD_TO_NEW, "TRACK", "1") == set()
    with pytest.raises(ValueError):
        known_parents(state, "elsewhere", spec.CUSTOMER)
