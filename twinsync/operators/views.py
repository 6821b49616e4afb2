"""List and detail queries, and the checks and cascades around deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.operators.state import Changes, State

# Fixed value: rows that were never mapped list first, as if mapped at the greatest date.
MAX_TIMESTAMP = "9999-12-31 23:59:59"

PAGE_ROWS = 1000


def list_old_customers(state: State) -> DataFrame:
    """Newest first."""
    return state["old_customer"].orderBy(F.desc("CustomerId"))


def list_old_invoices(state: State) -> DataFrame:
    """With the customer's name, newest first."""
    names = state["old_customer"].select("CustomerId", "FirstName", "LastName")
    return state["old_invoice"].join(names, "CustomerId", "left").orderBy(F.desc("InvoiceId"))


def last_mapped(mappings: DataFrame, key: str, name: str) -> DataFrame:
    """Latest mapping time per row."""
    return mappings.groupBy(F.col(key).alias(name)).agg(F.max("MappingTimestamp").alias("LastMapped"))


def by_last_mapping(rows: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """Latest mapped first; rows without a mapping come before all others."""
    listed = rows.join(times, key, "left").withColumn(
        "LastMapped", F.coalesce("LastMapped", F.lit(MAX_TIMESTAMP).cast("timestamp")))
    return listed.orderBy(F.desc("LastMapped"), key)


def list_new_customers(state: State) -> DataFrame:
    addresses = state["new_address"]
    rows = state["new_customer"].join(addresses, "AddressId", "left")
    return by_last_mapping(rows, last_mapped(state["map_customer"], "NewId", "CustomerId"), "CustomerId")


def list_new_invoices(state: State) -> DataFrame:
    names = state["new_customer"].select("CustomerId", "FirstName", "LastName")
    rows = state["new_invoice"].join(names, "CustomerId", "left")
    return by_last_mapping(rows, last_mapped(state["map_invoice"], "NewId", "InvoiceId"), "InvoiceId")


def list_new_addresses(state: State) -> DataFrame:
    return by_last_mapping(
        state["new_address"], last_mapped(state["map_address"], "AddressId", "AddressId"), "AddressId")


def nest_children(
    children: DataFrame, parent: str, child: str, fields: list[str], page_rows: int = PAGE_ROWS, parents: DataFrame | None = None
) -> DataFrame:
    """Children collected per parent, in pages of about ``page_rows``.

    A parent with more children than a page gets several rows (``page`` 0 to
    ``pages - 1``), its children spread over them by hash; so a parent that owns a
    third of all children is still built by many tasks, and no list grows without bound.
    ``parents`` may give the column ``parent`` of all children where it is cheaper to read.
    """
    sizes = (children if parents is None else parents).groupBy(parent).agg(F.count(F.lit(1)).alias("_n")).select(
        parent, F.ceil(F.col("_n") / page_rows).alias("pages"))
    spread = F.conv(F.substring(F.md5(F.col(child).cast("string")), 1, 8), 16, 10).cast("bigint")
    paged = children.join(sizes, parent).withColumn("page", F.pmod(spread, "pages")).repartition(parent, "page")
    return paged.groupBy(parent, "page").agg(
        F.max("pages").alias("pages"),
        F.array_sort(F.collect_list(F.struct(child, *fields))).alias("children"),
    )


def with_pages(headers: DataFrame, pages: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Headers with their pages; a header that owns nothing has one row without a page.

    In an inner join the adaptive skew join may split the pages of a hot parent, which it
    may not on the right side of a left join.  ``owners`` holds the keys that have pages.
    """
    bare = headers.join(owners.select(key).distinct(), key, "left_anti")
    return headers.join(pages, key).unionByName(bare, allowMissingColumns=True)


def invoice_details(
    invoices: DataFrame, customers: DataFrame, lines: DataFrame, page_rows: int = PAGE_ROWS, parents: DataFrame | None = None
) -> DataFrame:
    """Invoice header, customer name and nested lines; the same for the old and the new side.

    ``parents`` may give ``InvoiceId`` of all lines where it is cheaper to read than ``lines``.
    """
    parents = lines.select("InvoiceId") if parents is None else parents
    names = customers.select("CustomerId", "FirstName", "LastName")
    nested = nest_children(lines, "InvoiceId", "InvoiceLineId", ["TrackId", "UnitPrice", "Quantity"], page_rows, parents)
    headers = invoices.join(names, "CustomerId", "left")
    return with_pages(headers, nested.withColumnRenamed("children", "lines"), parents, "InvoiceId")


def address_details(state: State, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Addresses with nested customers and nested invoices.

    One row per page: an address has as many rows as the longer of its two lists has pages.
    """
    customers = nest_children(
        state["new_customer"], "AddressId", "CustomerId", ["FirstName", "LastName"], page_rows)
    invoices = nest_children(
        state["new_invoice"].withColumnRenamed("BillingAddressId", "AddressId"),
        "AddressId", "InvoiceId", ["Total"], page_rows)
    lists = (
        customers.select("AddressId", "page", F.col("children").alias("customers"))
        .join(invoices.select("AddressId", "page", F.col("children").alias("invoices")), ["AddressId", "page"], "full_outer")
    )
    owners = state["new_customer"].select("AddressId").distinct().unionByName(
        state["new_invoice"].select(F.col("BillingAddressId").alias("AddressId")).distinct())
    return with_pages(state["new_address"], lists, owners, "AddressId")


def delete_preview(state: State, chosen: DataFrame) -> DataFrame:
    """For customers about to be deleted: how many invoices go with each, and whether another customer shares the address."""
    customers = state["new_customer"].join(chosen, "CustomerId", "left_semi").select("CustomerId", "AddressId")
    counts = state["new_invoice"].join(chosen, "CustomerId", "left_semi").groupBy("CustomerId").agg(
        F.count(F.lit(1)).alias("invoices"))
    users = state["new_customer"].groupBy("AddressId").agg(F.count(F.lit(1)).alias("users"))
    return (
        customers.join(counts, "CustomerId", "left").join(users, "AddressId")
        .select("CustomerId", "AddressId", F.coalesce("invoices", F.lit(0)).alias("invoices"),
                (F.col("users") > 1).alias("address_shared"))
    )


def _removal(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.lit(True).alias("_deleted"))


def delete_invoices(state: State, chosen: DataFrame, side: str) -> Changes:
    """Remove a set of invoices with their lines (``chosen``: InvoiceId)."""
    lines = state[f"{side}_invoice_line"].join(chosen, "InvoiceId", "left_semi")
    invoices = state[f"{side}_invoice"].join(chosen, "InvoiceId", "left_semi")
    return Changes({
        f"{side}_invoice_line": _removal(lines, "InvoiceLineId"),
        f"{side}_invoice": _removal(invoices, "InvoiceId"),
    })


def delete_customers(state: State, chosen: DataFrame, side: str) -> Changes:
    """Remove a set of customers with their invoices and lines (``chosen``: CustomerId).

    On the new side their addresses go too, unless a remaining customer or invoice uses them.
    """
    customers = state[f"{side}_customer"].join(chosen, "CustomerId", "left_semi")
    invoices = state[f"{side}_invoice"].join(chosen, "CustomerId", "left_semi")
    changes = delete_invoices(state, invoices.select("InvoiceId"), side)
    changes.tables[f"{side}_customer"] = _removal(customers, "CustomerId")
    if side == spec.NEW:
        rest = state["new_customer"].join(chosen, "CustomerId", "left_anti").select("AddressId")
        billed = state["new_invoice"].join(chosen, "CustomerId", "left_anti").select(F.col("BillingAddressId").alias("AddressId"))
        unused = (
            customers.select("AddressId").distinct()
            .join(rest.distinct(), "AddressId", "left_anti").join(billed.distinct(), "AddressId", "left_anti")
        )
        changes.tables["new_address"] = _removal(unused, "AddressId")
    return changes


def restricted_addresses(state: State, chosen: DataFrame) -> DataFrame:
    """Addresses that must not be deleted, with how many customers and invoices use each."""
    customers = state["new_customer"].join(chosen, "AddressId", "left_semi").select(
        "AddressId", F.lit(1).alias("c"), F.lit(0).alias("i"))
    invoices = state["new_invoice"].withColumnRenamed("BillingAddressId", "AddressId").join(
        chosen, "AddressId", "left_semi").select("AddressId", F.lit(0).alias("c"), F.lit(1).alias("i"))
    return customers.unionByName(invoices).groupBy("AddressId").agg(
        F.sum("c").alias("customers"), F.sum("i").alias("invoices"))


# Foreign keys of the new side (table, column, parent table, parent key).
FOREIGN_KEYS = [
    ("new_customer", "AddressId", "new_address", "AddressId"),
    ("new_invoice", "CustomerId", "new_customer", "CustomerId"),
    ("new_invoice", "BillingAddressId", "new_address", "AddressId"),
    ("new_invoice_line", "InvoiceId", "new_invoice", "InvoiceId"),
    ("map_address", "AddressId", "new_address", "AddressId"),
]


def foreign_key_violations(state: State, keys: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Rows that refer to a parent that is not there."""
    found = None
    for table, column, parent, parent_key in FOREIGN_KEYS if keys is None else keys:
        children = state[table].select(
            F.lit(table).alias("table"), F.col(spec.TABLE_KEYS[table]).cast("string").alias("key"),
            F.lit(column).alias("column"), F.col(column).alias("missing"))
        parents = state[parent].select(F.col(parent_key).alias("missing"))
        bad = children.where("missing is not null").join(parents, "missing", "left_anti").select(
            "table", "key", "column", F.col("missing").cast("string").alias("missing"))
        found = bad if found is None else found.unionByName(bad)
    return found


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and has-data flag per table."""
    found = None
    for name, rows in tables.items():
        row = rows.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", (F.col("rows") > 0).alias("has_data"))
        found = row if found is None else found.unionByName(row)
    return found


def first_line_with_price(lines: DataFrame, price: Column) -> DataFrame:
    """Per invoice the line with the least id among those of one unit price."""
    return lines.where(F.col("UnitPrice") == price).groupBy("InvoiceId").agg(F.min("InvoiceLineId").alias("InvoiceLineId"))
