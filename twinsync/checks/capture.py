"""Change capture between two versions of each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.checks import common
from twinsync.checks.sql import NEW, address_key, query, surrogate
from twinsync.operators import capture
from twinsync.session import cut
from twinsync.sources import tpch


def _fields(outbox: DataFrame, names: list[str]) -> DataFrame:
    """Outbox rows with the payload opened; ``identified`` says the identifier is there."""
    return outbox.select(
        "aggregate_id", "aggregate_type", "event_type", F.length("unique_identifier").alias("identifier_length"),
        F.size(F.json_object_keys("payload")).alias("members"),
        *[_opened(n).alias(f"p_{n}") for n in names])


def _opened(name: str) -> Column:
    """One payload member; money as a decimal, because reading JSON drops trailing zeros."""
    member = F.get_json_object("payload", f"$.{name}")
    return member.cast("decimal(18,3)") if name in _MONEY else member


def _sql(before: str, after: str, key: str, aggregate: str, kind: str, names: dict[str, str], full: int, on_delete: dict[str, str]) -> str:
    """``names``: payload member to SQL text over the after row ``a``; ``on_delete``: the same over the before row ``b``."""
    body = ", ".join(
        f"case when a.{key} is not null then {sql} else {on_delete.get(n, 'null')} end as \"p_{n}\"" for n, sql in names.items())
    columns = " or ".join(f"a.{c} is distinct from b.{c}" for c in _COMPARED[kind])
    return f"""
select cast(coalesce(a.{aggregate}, b.{aggregate}) as varchar) as aggregate_id, '{kind}' as aggregate_type,
  case when b.{key} is null then 'CREATED' when a.{key} is null then 'DELETED' else 'UPDATED' end as event_type,
  32 as identifier_length, case when a.{key} is null then {len(on_delete)} else {full} end as members, {body}
from ({before}) b full outer join ({after}) a on a.{key} = b.{key}
where a.{key} is null or b.{key} is null or {columns}"""


_MONEY = {"Total", "UnitPrice", "TestValue3"}
_COMPARED = {
    "CUSTOMER": ["FirstName", "Email", "PostalCode"], "INVOICE": ["Total", "BillingPostalCode"],
    "INVOICELINE": ["Quantity", "UnitPrice"],
}


def _as_text(columns: list[str], row: str = "a") -> dict[str, str]:
    return {c: f"cast({row}.{c} as {'decimal(18,3)' if c in _MONEY else 'varchar'})" for c in columns}


# The old side ------------------------------------------------------------------------------


def capture_old_customer(spark: SparkSession, folder: str) -> DataFrame:
    """BUILDING customers appear, HOUSEHOLD customers vanish, MACHINERY customers change."""
    common.configure(spark)
    rows = tpch.old_customer(spark, folder)
    segment = F.col("LastName")
    after = rows.where(segment != "HOUSEHOLD").withColumn(
        "Email", F.when(segment == "MACHINERY", F.upper("Email")).otherwise(F.col("Email"))).withColumn(
        "PostalCode", F.when(segment == "MACHINERY", F.coalesce("PostalCode", F.lit("none"))).otherwise(F.col("PostalCode")))
    outbox = capture.capture_old_customer(rows.where(segment != "BUILDING"), after)
    return _fields(outbox, capture.CUSTOMER_PAYLOAD)


def capture_old_invoice(spark: SparkSession, folder: str) -> DataFrame:
    """Open orders appear, urgent ones vanish, large ones change; a column added later does not reach the payload."""
    common.configure(spark)
    rows = tpch.old_invoice(spark, folder, ["o_orderstatus", "o_orderpriority"])
    plain = [c for c in rows.columns if not c.startswith("o_")]
    before = rows.where("o_orderstatus <> 'O'").select(plain)
    after = rows.where("o_orderpriority <> '1-URGENT'").withColumn(
        "Total", F.when(F.col("Total") > 400000, F.col("Total") + 1).otherwise(F.col("Total")).cast("decimal(18,2)")).select(plain)
    outbox = capture.capture_old_invoice(before, after.withColumn("TestValue3", F.lit(None).cast("decimal(12,3)")))
    return _fields(outbox, capture.INVOICE_PAYLOAD).withColumn("p_InvoiceDate", F.substring("p_InvoiceDate", 1, 10))


def capture_old_line(spark: SparkSession, folder: str) -> DataFrame:
    """Unreturned lines appear, closed returns vanish, accepted ones change."""
    common.configure(spark)
    rows = cut(tpch.old_invoice_line(spark, folder, ["l_returnflag", "l_linestatus"]))  # numbered once for both versions
    flag = F.col("l_returnflag")
    before = rows.where(flag != "N").drop("l_returnflag", "l_linestatus")
    after = rows.where(~((flag == "R") & (F.col("l_linestatus") == "F"))).withColumn(
        "Quantity", F.when(flag == "A", F.col("Quantity") + 1).otherwise(F.col("Quantity"))).drop("l_returnflag", "l_linestatus")
    return _fields(capture.capture_old_line(before, after), capture.LINE_PAYLOAD)


# The new side ---------------------------------------------------------------------------------


def capture_new_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Unmapped BUILDING customers appear, mapped FURNITURE ones are echoes, HOUSEHOLD ones vanish, MACHINERY ones change."""
    state = common.edited_state(spark, folder)
    rows = state["new_customer"]
    segment = F.col("LastName")
    before = rows.where(~segment.isin("BUILDING", "FURNITURE"))
    after = rows.where(segment != "HOUSEHOLD").withColumn(
        "Email", F.when(segment == "MACHINERY", F.upper("Email")).otherwise(F.col("Email")))
    return _fields(capture.capture_new(before, after, spec.CUSTOMER, state), rows.columns)


def capture_new_address(spark: SparkSession, folder: str) -> DataFrame:
    """From the migrated addresses to the edited ones; a new spelling of a mapped address is an echo."""
    state = common.edited_state(spark, folder)
    before = common.base_state(spark, folder)["new_address"]
    outbox = capture.capture_new(before, state["new_address"], spec.ADDRESS, state)
    return _fields(outbox, ["AddressId", *spec.NEW_ADDRESS])


def capture_new_invoice(spark: SparkSession, folder: str) -> DataFrame:
    """Unmapped invoices appear, cheap ones vanish, large ones change."""
    state, full = common.base_state(spark, folder), common.full_state(spark, folder)
    after = full["new_invoice"].where("Total > 50000").withColumn(
        "Total", F.when(F.col("Total") > 400000, F.col("Total") + 1).otherwise(F.col("Total")).cast("decimal(18,2)"))
    outbox = capture.capture_new(state["new_invoice"], after, spec.INVOICE, state)
    return _fields(outbox, ["InvoiceId", "CustomerId", "BillingAddressId", "Total", "TestValue3"])


def capture_new_line(spark: SparkSession, folder: str) -> DataFrame:
    """Unmapped lines appear, single pieces vanish, dear ones change."""
    state, full = common.base_state(spark, folder), common.full_state(spark, folder)
    after = full["new_invoice_line"].where("Quantity > 1").withColumn(
        "Quantity", F.when(F.col("UnitPrice") > 90000, F.col("Quantity") + 1).otherwise(F.col("Quantity")))
    outbox = capture.capture_new(state["new_invoice_line"], after, spec.LINE, state)
    return _fields(outbox, ["InvoiceLineId", "InvoiceId", "TrackId", "UnitPrice", "Quantity"])


QUERIES = {
    "capture_old_customer": capture_old_customer,
    "capture_old_invoice": capture_old_invoice,
    "capture_old_line": capture_old_line,
    "capture_new_customer": capture_new_customer,
    "capture_new_address": capture_new_address,
    "capture_new_invoice": capture_new_invoice,
    "capture_new_line": capture_new_line,
}

_CUSTOMER = {
    n: "cast(null as varchar)" if n in ("Company", "Fax", "SupportRepId") else f"cast(a.{n} as varchar)"
    for n in capture.CUSTOMER_PAYLOAD
}
_INVOICE = {
    **_as_text(capture.INVOICE_PAYLOAD), "InvoiceDate": "strftime(a.InvoiceDate, '%Y-%m-%d')"}
_NEW_CUSTOMER = ["CustomerId", "FirstName", "LastName", "AddressId", "Phone", "Email"]
_NEW_INVOICE = ["InvoiceId", "CustomerId", "BillingAddressId", "Total", "TestValue3"]
_NEW_LINE = ["InvoiceLineId", "InvoiceId", "TrackId", "UnitPrice", "Quantity"]

ORACLES = {
    "capture_old_customer": query(_sql(
        "select * from all_customer where LastName <> 'BUILDING'",
        """select * replace (case when LastName = 'MACHINERY' then upper(Email) else Email end as Email,
             case when LastName = 'MACHINERY' then coalesce(PostalCode, 'none') else PostalCode end as PostalCode)
           from all_customer where LastName <> 'HOUSEHOLD'""",
        "CustomerId", "CustomerId", "CUSTOMER", _CUSTOMER, 13, {"CustomerId": "cast(b.CustomerId as varchar)"})),
    "capture_old_invoice": query(_sql(
        "select * from all_invoice where o_orderstatus <> 'O'",
        """select * replace (cast(case when Total > 400000 then Total + 1 else Total end as decimal(18,2)) as Total)
           from all_invoice where o_orderpriority <> '1-URGENT'""",
        "InvoiceId", "InvoiceId", "INVOICE", _INVOICE, 9, {"InvoiceId": "cast(b.InvoiceId as varchar)"})),
    "capture_old_line": query(_sql(
        "select * from all_line where l_returnflag <> 'N'",
        """select * replace (case when l_returnflag = 'A' then Quantity + 1 else Quantity end as Quantity)
           from all_line where not (l_returnflag = 'R' and l_linestatus = 'F')""",
        "InvoiceLineId", "InvoiceId", "INVOICELINE", _as_text(capture.LINE_PAYLOAD), 5,
        {"InvoiceLineId": "cast(b.InvoiceLineId as varchar)"})),
    "capture_new_customer": query(
        _sql("select *, null as PostalCode from side where LastName not in ('BUILDING', 'FURNITURE')",
             """select * replace (case when LastName = 'MACHINERY' then upper(Email) else Email end as Email), null as PostalCode
                from side where LastName not in ('HOUSEHOLD', 'FURNITURE')""",
             "CustomerId", "CustomerId", "CUSTOMER", _as_text(_NEW_CUSTOMER), 6, _as_text(_NEW_CUSTOMER, "b")),
        side=f"""select CustomerId, FirstName, LastName, AddressId, Phone, Email from base_new_customer
            union all select {surrogate('customer', 'CustomerId')}, FirstName, LastName, AddressId, Phone, Email
            from all_customer c join all_address a on {address_key(spec.OLD_ADDRESS, 'ignore_case', 'c.')} = a.MatchKey
            where LastName = 'BUILDING'"""),
    "capture_new_address": query(f"""
        select coalesce(a.AddressId, b.AddressId) as aggregate_id, 'ADDRESS' as aggregate_type,
          case when b.AddressId is null then 'CREATED' when a.AddressId is null then 'DELETED' else 'UPDATED' end as event_type,
          32 as identifier_length, 6 as members, coalesce(a.AddressId, b.AddressId) as "p_AddressId",
          {', '.join(f'case when a.AddressId is null then b.{c} else a.{c} end as "p_{c}"' for c in NEW)}
        from base_address b full outer join edited_address a on a.AddressId = b.AddressId
        where case when b.AddressId is null
                   then {address_key(NEW, 'trim_upper', 'a.')} not in (select {address_key(NEW, 'trim_upper')} from base_address)
                   else a.AddressId is null or a.Street is distinct from b.Street or a.City is distinct from b.City
                     or a.State is distinct from b.State or a.Country is distinct from b.Country or a.PostalCode is distinct from b.PostalCode end"""),
    "capture_new_invoice": query(_sql(
        "select *, null as BillingPostalCode from base_new_invoice",
        """select * replace (cast(case when Total > 400000 then Total + 1 else Total end as decimal(18,2)) as Total), null as BillingPostalCode
           from full_new_invoice where Total > 50000""",
        "InvoiceId", "InvoiceId", "INVOICE", _as_text(_NEW_INVOICE), 6, _as_text(_NEW_INVOICE, "b")).replace(
        "case when a.InvoiceId is null then 5 else 6 end as members", "6 as members").replace(
        "or a.Total is distinct", "or a.BillingAddressId is distinct from b.BillingAddressId or a.Total is distinct")),
    "capture_new_line": query(_sql(
        "select * from base_new_line",
        "select * replace (case when UnitPrice > 90000 then Quantity + 1 else Quantity end as Quantity) from full_new_line where Quantity > 1",
        "InvoiceLineId", "InvoiceId", "INVOICELINE", _as_text(_NEW_LINE), 5, _as_text(_NEW_LINE, "b"))),
}
