"""Whole batches against the event-by-event model, and batches against their parts."""

import random
from decimal import Decimal

import pytest
from model import BILLING, NEW_ADDRESS, OLD_ADDRESS, Model, exact_key, md5
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.operators import asof
from twinsync.operators.apply import (
    address_to_old, customer_to_new, customer_to_old, invoice_to_new, invoice_to_old, line_to_new, line_to_old,
)
from twinsync.operators.state import State, merge
from twinsync.session import cut

PLACES = [("a st", "c", "s", "k", "1"), ("A ST", "c", "s", "k", "1"), ("a st", "c", None, "k", "1"),
          ("a st", "c", "", "k", "1"), ("b st", "c", "s", "k", None), ("c st", "d", None, "k", None)]


def base_model(rng, customers=6, invoices=8, lines=10):
    """A few migrated rows; addresses are shared."""
    m = Model()
    for place in PLACES[:4]:
        address = md5("address", exact_key(place), "base")
        m.new_address[address] = place
        m.map_address[exact_key(place)] = address
    addresses = sorted(m.new_address)
    for k in range(customers):
        m.map_customer[k] = md5("customer", k)
        if rng.random() < 0.8:
            m.new_customer[md5("customer", k)] = (f"n{k}", rng.choice(addresses))
    for k in range(invoices):
        m.map_invoice[k] = md5("invoice", k)
        if rng.random() < 0.8 and m.new_customer:
            m.new_invoice[md5("invoice", k)] = (rng.choice(sorted(m.new_customer)), rng.choice(addresses), Decimal(k))
    for k in range(lines):
        m.map_line[k] = md5("invoiceline", k)
        if rng.random() < 0.8 and m.new_invoice:
            m.new_line[md5("invoiceline", k)] = (rng.choice(sorted(m.new_invoice)), k, 1)
    return m


def state_of(spark, m):
    def table(name, rows):
        return spark.createDataFrame(rows, spec.TABLE_SCHEMAS[name])

    return State(spark, {
        "new_address": table("new_address", [(k, *v) for k, v in m.new_address.items()]),
        "map_address": table("map_address", [(k, *m.new_address[a], a, None) for k, a in m.map_address.items()]),
        "new_customer": table("new_customer", [(k, v[0], "l", v[1], None, None) for k, v in m.new_customer.items()]),
        "new_invoice": table("new_invoice", [(k, v[0], None, v[1], v[2], Decimal(0)) for k, v in m.new_invoice.items()]),
        "new_invoice_line": table("new_invoice_line", [(k, v[0], v[1], Decimal(1), v[2]) for k, v in m.new_line.items()]),
        "map_customer": table("map_customer", [(k, v, None) for k, v in m.map_customer.items()]),
        "map_invoice": table("map_invoice", [(k, v, None) for k, v in m.map_invoice.items()]),
        "map_invoice_line": table("map_invoice_line", [(k, v, None) for k, v in m.map_line.items()]),
    })


def check(state, m, changes):
    after = merge(state, changes)

    def rows(name, *columns):
        return {r[0]: tuple(r)[1:] for r in after[name].select(*columns).collect()}

    assert rows("new_address", "AddressId", *NEW_ADDRESS) == m.new_address
    assert {k: v[0] for k, v in rows("map_address", "AddressKey", "AddressId").items()} == m.map_address
    assert rows("new_customer", "CustomerId", "FirstName", "AddressId") == m.new_customer
    assert rows("new_invoice", "InvoiceId", "CustomerId", "BillingAddressId", "Total") == m.new_invoice
    assert rows("new_invoice_line", "InvoiceLineId", "InvoiceId", "TrackId", "Quantity") == m.new_line
    for name, expected in [("map_customer", m.map_customer), ("map_invoice", m.map_invoice), ("map_invoice_line", m.map_line)]:
        assert {k: v[0] for k, v in rows(name, "OldId", "NewId").items()} == expected
    assert {r["seq"]: r["outcome"] for r in changes.outcomes.collect()} == m.fates


def operations(rng, n, keys):
    return [(rng.choice("ccuuud"), rng.randrange(keys)) for _ in range(n)]


CUSTOMER = "seq long, unique_identifier string, op string, CustomerId long, FirstName string, LastName string, " + \
    ", ".join(f"{c} string" for c in OLD_ADDRESS) + ", Phone string, Email string"
INVOICE = "seq long, unique_identifier string, op string, InvoiceId long, CustomerId long, InvoiceDate timestamp, " + \
    ", ".join(f"{c} string" for c in BILLING) + ", Total decimal(18,2), TestValue3 decimal(18,3)"
LINE = "seq long, unique_identifier string, op string, InvoiceLineId long, InvoiceId long, TrackId long, UnitPrice decimal(18,6), Quantity int"


@pytest.mark.parametrize("seed", range(6))
def test_customers_equal_model(spark, seed):
    rng = random.Random(seed)
    m = base_model(rng)
    state = state_of(spark, m)
    events = [
        {"seq": i, "unique_identifier": f"u{i}", "op": op, "CustomerId": k, "FirstName": f"v{i}",
         **dict(zip(OLD_ADDRESS, rng.choice(PLACES)))}
        for i, (op, k) in enumerate(operations(rng, 25, 10))
    ]
    frame = spark.createDataFrame(
        [(e["seq"], e["unique_identifier"], e["op"], e["CustomerId"], e["FirstName"], "l", *[e[c] for c in OLD_ADDRESS], None, None)
         for e in events], CUSTOMER)
    m.customers(events)
    check(state, m, customer_to_new(state, frame))


@pytest.mark.parametrize(("seed", "small"), [(1, 0), (1, 1000), (2, 20)])
def test_customers_in_any_batches_equal_model(spark, monkeypatch, seed, small):
    """Few places, so addresses are shared, overwritten and found again; the cuts of the stream are random.

    ``small`` decides which groups of events go through in order and which by rounds.
    """
    monkeypatch.setattr(asof, "SMALL", small)
    rng = random.Random(100 + seed)
    m = base_model(rng)
    state = state_of(spark, m)
    events = [
        {"seq": i, "unique_identifier": f"u{i}", "op": op, "CustomerId": k, "FirstName": f"v{i}", **dict(zip(OLD_ADDRESS, rng.choice(PLACES)))}
        for i, (op, k) in enumerate(operations(rng, 60, 16))
    ]
    m.customers(events)
    fates, start = {}, 0
    for end in [*sorted(rng.sample(range(1, 60), seed)), 60]:
        frame = spark.createDataFrame(
            [(e["seq"], e["unique_identifier"], e["op"], e["CustomerId"], e["FirstName"], "l", *[e[c] for c in OLD_ADDRESS], None, None)
             for e in events[start:end]], CUSTOMER)
        changes = customer_to_new(state, frame)
        fates |= {r["seq"]: r["outcome"] for r in changes.outcomes.collect()}
        if end < 60:
            state = merge(state, changes)
            state = state.replace(**{n: cut(t) for n, t in state.tables.items()})
        start = end
    assert fates == m.fates
    m.fates = {r["seq"]: r["outcome"] for r in changes.outcomes.collect()}
    check(state, m, changes)


def test_an_address_is_found_as_it_is_then(spark):
    """1 leaves the place after 7 has found it and before 8 looks; 9 finds what 7's update has become."""
    a, b = PLACES[0], PLACES[4]
    m = Model()
    m.new_address["a0"] = a
    m.map_address[exact_key(a)] = "a0"
    m.map_customer[1] = md5("customer", 1)
    m.new_customer[md5("customer", 1)] = ("n1", "a0")
    steps = [("c", 7, a), ("u", 1, b), ("c", 8, a), ("u", 7, PLACES[5]), ("c", 9, PLACES[5]), ("u", 8, b), ("c", 10, b), ("c", 11, a)]
    events = [{"seq": i, "unique_identifier": f"u{i}", "op": op, "CustomerId": k, "FirstName": f"v{i}", **dict(zip(OLD_ADDRESS, place))}
              for i, (op, k, place) in enumerate(steps)]
    frame = spark.createDataFrame(
        [(e["seq"], e["unique_identifier"], e["op"], e["CustomerId"], e["FirstName"], "l", *[e[c] for c in OLD_ADDRESS], None, None)
         for e in events], CUSTOMER)
    state = state_of(spark, m)
    m.customers(events)
    check(state, m, customer_to_new(state, frame))
    owner = {k: m.new_customer[md5("customer", k)][1] for k in (1, 7, 8, 9, 10, 11)}
    assert owner[7] == owner[1] == owner[9] == "a0" and owner[8] not in ("a0", owner[11])


@pytest.mark.parametrize("seed", range(4))
def test_invoices_equal_model(spark, seed):
    rng = random.Random(seed)
    m = base_model(rng)
    state = state_of(spark, m)
    places = [*PLACES, (None, "", None, None, "")]
    events = [
        {"seq": i, "unique_identifier": f"u{i}", "op": op, "InvoiceId": k, "CustomerId": rng.randrange(8),
         "Total": Decimal(i), **dict(zip(BILLING, rng.choice(places)))}
        for i, (op, k) in enumerate(operations(rng, 25, 12))
    ]
    frame = spark.createDataFrame(
        [(e["seq"], e["unique_identifier"], e["op"], e["InvoiceId"], e["CustomerId"], None, *[e[c] for c in BILLING],
          e["Total"], None) for e in events], INVOICE)
    for e in events:
        m.fates[e["seq"]] = m.invoice(e)
    check(state, m, invoice_to_new(state, frame))


@pytest.mark.parametrize("seed", range(4))
def test_lines_equal_model(spark, seed):
    rng = random.Random(seed)
    m = base_model(rng)
    state = state_of(spark, m)
    events = [
        {"seq": i, "unique_identifier": f"u{i}", "op": op, "InvoiceLineId": k, "InvoiceId": rng.randrange(10),
         "TrackId": i, "Quantity": i}
        for i, (op, k) in enumerate(operations(rng, 30, 14))
    ]
    frame = spark.createDataFrame(
        [(e["seq"], e["unique_identifier"], e["op"], e["InvoiceLineId"], e["InvoiceId"], e["TrackId"], Decimal(1), e["Quantity"])
         for e in events], LINE)
    for e in events:
        m.fates[e["seq"]] = m.line(e)
    check(state, m, line_to_new(state, frame))


def test_replay_changes_nothing(spark):
    rng = random.Random(1)
    m = base_model(rng)
    state = state_of(spark, m)
    events = spark.createDataFrame(
        [(1, "a", "c", 77, 1, 5, Decimal(1), 2), (2, "b", "u", 77, 1, 6, Decimal(1), 3)], LINE)
    once = merge(state, line_to_new(state, events))
    again = line_to_new(once, events)
    assert again.tables["new_invoice_line"].count() == 0
    assert again.tables["map_invoice_line"].count() == 0


def test_columns_nobody_knows_are_kept(spark):
    m = base_model(random.Random(3))
    state = state_of(spark, m)
    state = state.replace(new_invoice_line=state["new_invoice_line"].withColumn("Note", F.lit("keep")))
    key = next(k for k, v in m.map_line.items() if v in m.new_line)
    events = spark.createDataFrame([(1, "a", "u", key, 1, 99, Decimal(1), 9)], LINE)
    row = merge(state, line_to_new(state, events))["new_invoice_line"].where(F.col("TrackId") == 99).first()
    assert (row["Quantity"], row["Note"]) == (9, "keep")


# New to old -----------------------------------------------------------------------------------


@pytest.fixture
def both(spark):
    """Two mapped customers on both sides, one new customer, addresses, one invoice each."""
    home, other = ("s", "c", None, "k", "1"), ("t", "c", "x", "k", None)
    t = lambda n, rows: spark.createDataFrame(rows, spec.TABLE_SCHEMAS[n])
    return State(spark, {
        "new_address": t("new_address", [("a1", *home), ("a2", *other)]),
        "map_address": t("map_address", [(exact_key(home), *home, "a1", None)]),
        "new_customer": t("new_customer", [("n1", "f", "l", "a1", None, None), ("n2", "f", "l", "a1", None, None),
                                           ("n3", "f", "l", "a2", None, None)]),
        "map_customer": t("map_customer", [(1, "n1", None), (2, "n2", None)]),
        "old_customer": t("old_customer", [(1, "f", "l", *home, None, None), (2, "f", "l", *home, None, None)]),
        "old_invoice": t("old_invoice", [(10, 1, None, *home, Decimal(5)), (11, 2, None, "else", "c", None, "k", None, Decimal(6))]),
        "old_invoice_line": t("old_invoice_line", [(100, 10, 1, Decimal(1), 1)]),
        "map_invoice": t("map_invoice", [(10, "i1", None), (11, "i2", None)]),
        "map_invoice_line": t("map_invoice_line", [(100, "l1", None)]),
    })


NEW_CUSTOMER = "seq long, unique_identifier string, op string, CustomerId string, FirstName string, LastName string, AddressId string, Phone string, Email string"
NEW_INVOICE = "seq long, unique_identifier string, op string, InvoiceId string, CustomerId string, InvoiceDate timestamp, BillingAddressId string, Total decimal(18,2), TestValue3 decimal(18,3)"
NEW_LINE = "seq long, unique_identifier string, op string, InvoiceLineId string, InvoiceId string, TrackId long, UnitPrice decimal(18,6), Quantity int"


def fates(changes):
    return [r["outcome"] for r in changes.outcomes.orderBy("seq").collect()]


def test_customer_to_old(spark, both):
    events = spark.createDataFrame([
        (1, "u1", "c", "n3", "new", "l", "a2", None, None), (2, "u2", "c", "n1", "echo", "l", "a1", None, None),
        (3, "u3", "u", "n1", "f2", "l", "a2", "p", None), (4, "u4", "d", "n2", None, None, None, None, None),
        (5, "u5", "u", "n9", "x", "l", "a1", None, None), (6, "u6", "u", "n3", "x", "l", "gone", None, None),
    ], NEW_CUSTOMER)
    changes = customer_to_old(both, events)
    assert fates(changes) == ["applied", "skip:already_mapped", "applied", "applied", "dead:mapping_missing", "dead:address_missing"]
    after = merge(both, changes)
    customers = {r["CustomerId"]: r for r in after["old_customer"].collect()}
    assert customers.keys() == {1, 3}
    assert (customers[1]["FirstName"], customers[1]["Address"], customers[3]["FirstName"], customers[3]["State"]) == ("f2", "t", "new", "x")
    # All invoices of the updated customer get the address; the mapping of the address n1 has on the new side follows.
    assert after["old_invoice"].where("InvoiceId = 10").first()["BillingAddress"] == "t"
    mapping = after["map_address"].collect()
    assert [(r["AddressKey"], r["AddressId"]) for r in mapping] == [(exact_key(("t", "c", "x", "k", None)), "a1")]
    assert after["map_customer"].where("NewId = 'n3'").first()["OldId"] == 3


def test_address_update_reaches_equal_rows_only(spark, both):
    events = spark.createDataFrame([
        (1, "u1", "u", "a1", " moved ", "c", None, "k", "1"), (2, "u2", "c", "a2", "t", "c", "x", "k", None),
        (3, "u3", "u", "a1", "moved again", "c", None, "k", "1"), (4, "u4", "u", "a1", "", "c", None, "k", "1"),
        (5, "u5", "u", "a2", "t2", "c", "x", "k", None), (6, "u6", "c", "a1", "s", "c", None, "k", "1"),
    ], "seq long, unique_identifier string, op string, AddressId string, Street string, City string, State string, Country string, PostalCode string")
    changes = address_to_old(both, events)
    assert fates(changes) == ["applied", "applied", "applied", "skip:incomplete_address", "dead:mapping_missing", "skip:already_mapped"]
    after = merge(both, changes)
    assert {r["Address"] for r in after["old_customer"].collect()} == {"moved again"}
    assert {r["InvoiceId"]: r["BillingAddress"] for r in after["old_invoice"].collect()} == {10: "moved again", 11: "else"}


def test_invoice_and_line_to_old(spark, both):
    events = spark.createDataFrame([
        (1, "u1", "c", "i3", "n2", None, "a2", Decimal(7), None), (2, "u2", "u", "i1", "n2", None, "a2", Decimal(8), None),
        (3, "u3", "c", "i4", "n3", None, "a2", Decimal(9), None), (4, "u4", "d", "i2", None, None, None, None, None),
        (5, "u5", "u", "i2", "n1", None, "a2", Decimal(1), None),
    ], NEW_INVOICE)
    changes = invoice_to_old(both, events)
    assert fates(changes) == ["applied", "applied", "dead:parent_missing", "applied", "skip:row_missing"]
    state = merge(both, changes)
    invoices = {r["InvoiceId"]: r for r in state["old_invoice"].collect()}
    assert invoices.keys() == {10, 12}
    # The billing address is the customer's, not the event's.
    assert (invoices[12]["CustomerId"], invoices[12]["BillingAddress"], invoices[10]["CustomerId"]) == (2, "s", 2)
    untimed = state["map_invoice"].where("NewId = 'i3'").select(F.year("MappingTimestamp")).first()[0]
    assert untimed == 1
    lines = spark.createDataFrame([
        (1, "v1", "c", "l2", "i3", 5, Decimal(2), 3), (2, "v2", "u", "l1", "i3", 6, Decimal(2), 4),
        (3, "v3", "c", "l3", "i4", 5, Decimal(2), 3), (4, "v4", "d", "l9", "i3", None, None, None),
    ], NEW_LINE)
    changes = line_to_old(state, lines)
    assert fates(changes) == ["applied", "applied", "dead:parent_missing", "skip:not_mapped"]
    after = {r["InvoiceLineId"]: (r["InvoiceId"], r["TrackId"]) for r in merge(state, changes)["old_invoice_line"].collect()}
    assert after == {100: (12, 6), 101: (12, 5)}
