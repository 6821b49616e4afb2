"""Change capture: two versions of a table become outbox rows.

A full outer join on the key gives created, updated and deleted rows; unchanged rows
vanish.  Keys are unique on both sides, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.functions.addresses import TRIM_UPPER, address_key
from twinsync.operators.lookup import TABLES
from twinsync.operators.state import State

# Columns of the old payloads, in order; a deletion carries the key only.
CUSTOMER_PAYLOAD = [
    "CustomerId", "FirstName", "LastName", "Company", "Address", "City", "State", "Country",
    "PostalCode", "Phone", "Fax", "Email", "SupportRepId",
]
INVOICE_PAYLOAD = [
    "InvoiceId", "CustomerId", "InvoiceDate", "BillingAddress", "BillingCity", "BillingState",
    "BillingCountry", "BillingPostalCode", "Total",
]
LINE_PAYLOAD = ["InvoiceLineId", "InvoiceId", "TrackId", "UnitPrice", "Quantity"]


def json_payload(columns: dict[str, Column]) -> Column:
    """JSON object from a column mapping, nulls written out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def _payload_of(row: str, names: list[str], available: list[str]) -> Column:
    """Payload with the given names; a column the table does not have is null."""
    return json_payload({
        n: F.col(f"{row}.{n}") if n in available else F.lit(None).cast("string") for n in names
    })


def capture_changes(
    before: DataFrame,
    after: DataFrame,
    key: str,
    aggregate_column: str,
    aggregate_type: str,
    payload: list[str],
    delete_payload: list[str],
    captured_at: Column | None = None,
    capture: str | None = None,
) -> DataFrame:
    """Outbox rows for the difference of two table versions.

    ``capture`` names the pair of versions (a sequence number will do).  ``unique_identifier``
    is made from it, the row and its image: capturing the same pair again gives the same
    identifiers, and a row that returns to an earlier image gets a new one.  Without a name
    the time of capture takes its place.
    """
    old = before.select(F.col(key).alias("_key"), F.struct(*before.columns).alias("b"))
    new = after.select(F.col(key).alias("_key"), F.struct(*after.columns).alias("a"))
    shared = [c for c in after.columns if c in before.columns]
    added = [c for c in after.columns if c not in before.columns]
    differs = ~F.struct(*[F.col(f"b.{c}") for c in shared]).eqNullSafe(F.struct(*[F.col(f"a.{c}") for c in shared]))
    for column in added:
        differs = differs | F.col(f"a.{column}").isNotNull()
    joined = old.join(new, "_key", "full_outer").where(F.col("b").isNull() | F.col("a").isNull() | differs)
    kind = F.when(F.col("b").isNull(), "CREATED").when(F.col("a").isNull(), "DELETED").otherwise("UPDATED")
    body = F.when(F.col("a").isNull(), _payload_of("b", delete_payload, before.columns)).otherwise(
        _payload_of("a", payload, after.columns))
    at = F.current_timestamp() if captured_at is None else captured_at
    named = F.lit(capture) if capture is not None else at.cast("timestamp").cast("string")
    return joined.select(
        F.coalesce(f"a.{aggregate_column}", f"b.{aggregate_column}").cast("string").alias("aggregate_id"),
        F.lit(aggregate_type).alias("aggregate_type"),
        kind.alias("event_type"),
        body.alias("payload"),
        F.md5(F.concat_ws("|", named, F.lit(aggregate_type), F.col("_key").cast("string"), kind, body)).alias("unique_identifier"),
        at.cast("timestamp").alias("created_at"),
    )


def capture_old_customer(before: DataFrame, after: DataFrame, captured_at: Column | None = None, capture: str | None = None) -> DataFrame:
    return capture_changes(
        before, after, "CustomerId", "CustomerId", spec.CUSTOMER, CUSTOMER_PAYLOAD, ["CustomerId"], captured_at, capture)


def capture_old_invoice(before: DataFrame, after: DataFrame, captured_at: Column | None = None, capture: str | None = None) -> DataFrame:
    return capture_changes(
        before, after, "InvoiceId", "InvoiceId", spec.INVOICE, INVOICE_PAYLOAD, ["InvoiceId"], captured_at, capture)


def capture_old_line(before: DataFrame, after: DataFrame, captured_at: Column | None = None, capture: str | None = None) -> DataFrame:
    """A line's aggregate is its invoice."""
    return capture_changes(
        before, after, "InvoiceLineId", "InvoiceId", spec.LINE, LINE_PAYLOAD, ["InvoiceLineId"], captured_at, capture)


def capture_new(
    before: DataFrame, after: DataFrame, entity: str, state: State, captured_at: Column | None = None, capture: str | None = None
) -> DataFrame:
    """Changes on the new side: full rows also for deletions, creations only of rows without a mapping."""
    key = spec.ROW_KEY[entity]
    aggregate = "InvoiceId" if entity == spec.LINE else key
    unmapped = _without_mapping(after, before, entity, state)
    return capture_changes(before, unmapped, key, aggregate, entity, after.columns, before.columns, captured_at, capture)


def _without_mapping(after: DataFrame, before: DataFrame, entity: str, state: State) -> DataFrame:
    """Drop rows that are new in ``after`` and already mapped: they came from the old side."""
    key = spec.ROW_KEY[entity]
    if entity == spec.ADDRESS:
        keyed = after.withColumn("_match", address_key(spec.NEW_ADDRESS, TRIM_UPPER))
        known = state["map_address"].select(address_key(spec.NEW_ADDRESS, TRIM_UPPER).alias("_match")).distinct()
        mapped = keyed.join(known, "_match", "left_semi").select(key)
    else:
        known = state[f"map_{TABLES[entity]}"].select(F.col("NewId").alias(key))
        mapped = after.select(key).join(known, key, "left_semi")
    echoes = mapped.join(before.select(key), key, "left_anti")
    return after.join(echoes, key, "left_anti")
