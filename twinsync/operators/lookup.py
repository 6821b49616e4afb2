"""Joins that resolve ids: existence, translation, parents and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.functions.addresses import EXACT, address_key
from twinsync.operators.state import State

TABLES = {spec.CUSTOMER: "customer", spec.INVOICE: "invoice", spec.LINE: "invoice_line"}


def restrict(base: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of a large table whose key occurs in a batch.

    A semi-join: when the batch is small the optimizer broadcasts its keys and the
    table is scanned, not shuffled; later joins then see the small remainder only.
    Repeated keys are dropped on the map side first, since a hot key on the right of a
    semi-join cannot be split.
    """
    columns = [on] if isinstance(on, str) else on
    return base.join(keys.select(*columns).distinct(), columns, "left_semi")


def mapping(state: State, entity: str, to_side: str) -> DataFrame:
    """Id mapping as ``key`` (source side) and ``target``."""
    source, target = ("OldId", "NewId") if to_side == spec.NEW else ("NewId", "OldId")
    return state[f"map_{TABLES[entity]}"].select(F.col(source).alias("key"), F.col(target).alias("target"))


def find_targets(state: State, entity: str, to_side: str, keys: DataFrame, with_row: bool = True) -> DataFrame:
    """``key, target, present`` for every mapped key: its id on the other side, and whether that row exists.

    ``with_row`` adds the stored row itself as ``cur``, so that it is looked up only once.
    """
    table = f"{to_side}_{TABLES[entity]}"
    mapped = restrict(mapping(state, entity, to_side), keys, "key")
    row = [F.struct("*").alias("cur")] if with_row else []
    rows = state[table].select(F.col(spec.TABLE_KEYS[table]).alias("target"), F.lit(True).alias("present"), *row)
    found = mapped.join(restrict(rows, mapped, "target"), "target", "left")
    return found.select("key", "target", F.coalesce("present", F.lit(False)).alias("present"), *(["cur"] if with_row else []))


def with_parent(events: DataFrame, state: State, entity: str, to_side: str, column: str) -> DataFrame:
    """Translate a foreign id: adds ``<column>_target`` and ``<column>_present``."""
    keys = events.select(F.col(column).alias("key")).distinct()
    found = find_targets(state, entity, to_side, keys, with_row=False).select(
        F.col("key").alias(column),
        F.col("target").alias(f"{column}_target"),
        F.col("present").alias(f"{column}_present"),
    )
    return events.join(found, column, "left")


def first_address_by_key(addresses: DataFrame, keys: DataFrame, mode: str = EXACT) -> DataFrame:
    """``AddressKey, AddressId``: the least id of the addresses that have each wanted key."""
    keyed = addresses.select(address_key(spec.NEW_ADDRESS, mode).alias("AddressKey"), "AddressId")
    return restrict(keyed, keys, "AddressKey").groupBy("AddressKey").agg(F.min("AddressId").alias("AddressId"))


def dependency_exists(needs: DataFrame, state: State, source: str, parent: str) -> DataFrame:
    """Rows of ``needs`` (with a text column ``dep_id``) whose parent is known on the target side.

    ``CREATE_NEW_ADDRESS`` always counts as known; an unknown parent type never does.
    """
    always = needs.where(F.col("dep_id") == spec.CREATE_NEW_ADDRESS)
    rest = needs.where(F.col("dep_id") != spec.CREATE_NEW_ADDRESS)
    known = known_parents(state, source, parent)
    return always if known is None else always.unionByName(rest.join(known, "dep_id", "left_semi"))


def known_parents(state: State, source: str, parent: str) -> DataFrame | None:
    """Ids, as text, that satisfy a dependency on ``parent`` for events of one direction.

    Whole tables, lazily: the gate restricts them to the ids a batch asks for before
    anything is shuffled.
    """
    if source not in (spec.OLD_TO_NEW, spec.NEW_TO_OLD):
        raise ValueError(f"unknown source {source!r}")
    side = spec.NEW if source == spec.OLD_TO_NEW else spec.OLD
    if parent in TABLES:
        return mapping(state, parent, side).select(F.col("key").cast("string").alias("dep_id"))
    if parent != spec.ADDRESS:
        return None
    if source == spec.NEW_TO_OLD:
        return state["map_address"].select(F.col("AddressId").alias("dep_id"))
    return _old_rows_with_known_address(state)


def _old_rows_with_known_address(state: State) -> DataFrame:
    """Old ids read as a customer id, else as an invoice id, whose address is mapped."""
    customers = state["old_customer"].select(
        F.col("CustomerId").alias("id"), address_key(spec.OLD_ADDRESS, EXACT).alias("AddressKey"))
    invoices = state["old_invoice"].select(
        F.col("InvoiceId").alias("id"), address_key(spec.BILLING_ADDRESS, EXACT).alias("AddressKey"))
    invoices = invoices.join(customers.select("id"), "id", "left_anti")
    known = state["map_address"].select("AddressKey")
    return (
        customers.unionByName(invoices).join(known, "AddressKey", "left_semi")
        .select(F.col("id").cast("string").alias("dep_id"))
    )


def same_row(left: list[Column], right: list[Column]) -> Column:
    """All columns are equal, null equal to null."""
    return F.struct(*left).eqNullSafe(F.struct(*right))


def duplicate_mappings(map_address: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted address keys that another address already holds (``wanted``: AddressId, AddressKey)."""
    held = restrict(map_address.select("AddressKey", F.col("AddressId").alias("HolderId")), wanted, "AddressKey")
    return (
        wanted.join(held, "AddressKey")
        .where(F.col("HolderId") != F.col("AddressId"))
        .select("AddressId", "AddressKey", "HolderId")
    )
