"""Views, integrity checks, reconciliation, timeline, logs and table mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.checks import common
from twinsync.checks.sql import BILL, NEW, OLD, address_key, query, surrogate
from twinsync.functions.keys import surrogate_key
from twinsync.operators import mutate, reconcile, views
from twinsync.operators.state import State
from twinsync.session import configure
from twinsync.sources import logs, outbox, tpch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function
    return add


def _millis(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.unix_millis(c))
    return rows


# Lists --------------------------------------------------------------------------------------


@registered(query("""select CustomerId, FirstName, LastName, Address, City, State, Country, PostalCode, Phone, Email from all_customer"""))
def list_old_customers(spark: SparkSession, folder: str) -> DataFrame:
    return views.list_old_customers(common.old_state(spark, folder))


@registered(query(f"""
select i.InvoiceId, i.CustomerId, epoch_ms(i.InvoiceDate) as InvoiceDate, {', '.join(f'i.{c}' for c in BILL)}, i.Total, c.FirstName, c.LastName
from all_invoice i join all_customer c on c.CustomerId = i.CustomerId"""))
def list_old_invoices(spark: SparkSession, folder: str) -> DataFrame:
    return _millis(views.list_old_invoices(common.old_state(spark, folder)), "InvoiceDate")


def mapped_state(spark: SparkSession, folder: str) -> State:
    """All rows migrated; mapping times are those of the events of each customer, order or customer's address."""
    state = common.full_state(spark, folder)
    events = tpch.table(spark, folder, "events").select("event_id", "user_id", tpch.utc("ts").alias("MappingTimestamp"))
    addressed = state["new_customer"].select(F.col("CustomerId").alias("NewId"), "AddressId")
    customers = events.select(
        F.col("user_id").alias("OldId"), surrogate_key("customer", "user_id").alias("NewId"), "MappingTimestamp")
    return state.replace(
        map_customer=customers,
        map_invoice=events.select(
            F.col("event_id").alias("OldId"), surrogate_key("invoice", "event_id").alias("NewId"), "MappingTimestamp"),
        map_address=customers.join(addressed, "NewId").select("AddressId", "MappingTimestamp"),
    )


_LAST = "coalesce(epoch_us(t) // 1000, 253402300799000)"


@registered(query(f"""
select c.CustomerId, c.FirstName, c.LastName, c.AddressId, c.Phone, c.Email, {', '.join(f'a.{c}' for c in NEW)}, {_LAST} as LastMapped
from full_new_customer c join all_address a on a.AddressId = c.AddressId
left join (select user_id, max(ts) as t from events group by user_id) e on e.user_id = c.OldId"""))
def list_new_customers(spark: SparkSession, folder: str) -> DataFrame:
    return _millis(views.list_new_customers(mapped_state(spark, folder)), "LastMapped")


@registered(query(f"""
select i.InvoiceId, i.CustomerId, epoch_ms(i.InvoiceDate) as InvoiceDate, i.BillingAddressId, i.Total, i.TestValue3,
  c.FirstName, c.LastName, {_LAST} as LastMapped
from full_new_invoice i join full_new_customer c on c.CustomerId = i.CustomerId
left join (select event_id, max(ts) as t from events group by event_id) e on e.event_id = i.OldId"""))
def list_new_invoices(spark: SparkSession, folder: str) -> DataFrame:
    return _millis(views.list_new_invoices(mapped_state(spark, folder)), "InvoiceDate", "LastMapped")


@registered(query(f"""
select a.AddressId, {', '.join(f'a.{c}' for c in NEW)}, {_LAST} as LastMapped from all_address a
left join (select c.AddressId, max(ts) as t from events join full_new_customer c on c.OldId = user_id group by c.AddressId) e
  on e.AddressId = a.AddressId"""))
def list_new_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return _millis(views.list_new_addresses(mapped_state(spark, folder)), "LastMapped")


# Details ---------------------------------------------------------------------------------------


def _joined(items: str, *fields: str) -> Column:
    return F.array_join(
        F.transform(items, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("~")) for f in fields])), ",")


def _pages(child: str, parent: str, key: str, rows: int) -> str:
    """Children with their page, as the hash of the child's id gives it."""
    return f"""select *, ceil(count(*) over (partition by {parent}) / {rows}.0)::bigint as pages,
        cast('0x' || substr(md5(cast({key} as varchar)), 1, 8) as bigint) % ceil(count(*) over (partition by {parent}) / {rows}.0)::bigint as page
        from {child}"""


def _detail_sql(invoices: str, customers: str, lines: str) -> str:
    return query(f"""
select i.InvoiceId, i.CustomerId, i.Total, c.FirstName, c.LastName, l.page, l.pages, l.lines
from {invoices} i join {customers} c on c.CustomerId = i.CustomerId
left join (select InvoiceId, page, max(pages) as pages,
    string_agg(cast(InvoiceLineId as varchar) || ':' || cast(TrackId as varchar) || ':' || cast(UnitPrice as varchar) || ':' || cast(Quantity as varchar),
      ',' order by InvoiceLineId) as lines
  from paged group by InvoiceId, page) l on l.InvoiceId = i.InvoiceId""",
        paged=_pages(lines, "InvoiceId", "InvoiceLineId", 3))


def _invoice_details(state: State, side: str, parents: DataFrame | None = None) -> DataFrame:
    rows = views.invoice_details(
        state[f"{side}_invoice"], state[f"{side}_customer"], state[f"{side}_invoice_line"], page_rows=3, parents=parents)
    return rows.select(
        "InvoiceId", "CustomerId", "Total", "FirstName", "LastName", "page", "pages",
        _joined("lines", "InvoiceLineId", "TrackId", "UnitPrice", "Quantity").alias("lines"))


@registered(_detail_sql("all_invoice", "all_customer", "all_line"))
def invoice_details_old(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of three lines, so that most invoices have several."""
    return _invoice_details(common.old_state(spark, folder), spec.OLD, tpch.line_invoices(spark, folder))


@registered(_detail_sql("full_new_invoice", "full_new_customer", "full_new_line"))
def invoice_details_new(spark: SparkSession, folder: str) -> DataFrame:
    return _invoice_details(common.full_state(spark, folder), spec.NEW)


@registered(query(f"""
select a.AddressId, a.Street, a.City, l.page, l.customers, l.invoices from all_address a left join (
  select coalesce(c.AddressId, i.AddressId) as AddressId, coalesce(c.page, i.page) as page, c.customers, i.invoices
  from (select AddressId, page, string_agg(CustomerId || ':' || FirstName, ',' order by CustomerId) as customers from pc group by 1, 2) c
  full outer join (select BillingAddressId as AddressId, page, string_agg(InvoiceId || ':' || cast(Total as varchar), ',' order by InvoiceId) as invoices
    from pi group by 1, 2) i on i.AddressId = c.AddressId and i.page = c.page) l on l.AddressId = a.AddressId""",
    pc=_pages("full_new_customer", "AddressId", "CustomerId", 20), pi=_pages("full_new_invoice", "BillingAddressId", "InvoiceId", 20)))
def address_details(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.address_details(common.full_state(spark, folder), page_rows=20)
    return rows.select(
        "AddressId", "Street", "City", "page", _joined("customers", "CustomerId", "FirstName").alias("customers"),
        _joined("invoices", "InvoiceId", "Total").alias("invoices"))


# Deletions and integrity --------------------------------------------------------------------------


def _segment(state: State, segment: str) -> DataFrame:
    return state["new_customer"].where(F.col("LastName") == segment).select("CustomerId")


@registered(query("""
select CustomerId, AddressId, coalesce(n, 0) as invoices, users > 1 as address_shared from full_new_customer c
left join (select CustomerId as cid, count(*) as n from full_new_invoice group by 1) i on i.cid = c.CustomerId
join (select AddressId as aid, count(*) as users from full_new_customer group by 1) u on u.aid = c.AddressId
where LastName = 'MACHINERY'"""))
def delete_preview(spark: SparkSession, folder: str) -> DataFrame:
    state = common.full_state(spark, folder)
    return views.delete_preview(state, _segment(state, "MACHINERY"))


@registered(query("""
select 'new_customer' as "table", CustomerId as key, true as deleted, '' as content from gone
union all select 'new_invoice', InvoiceId, true, '' from full_new_invoice where CustomerId in (select CustomerId from gone)
union all select 'new_invoice_line', InvoiceLineId, true, '' from full_new_line
  where InvoiceId in (select InvoiceId from full_new_invoice where CustomerId in (select CustomerId from gone))
union all select distinct 'new_address', AddressId, true, '' from gone
  where AddressId not in (select AddressId from full_new_customer where LastName <> 'MACHINERY')
    and AddressId not in (select BillingAddressId from full_new_invoice where CustomerId not in (select CustomerId from gone))""",
    gone="select * from full_new_customer where LastName = 'MACHINERY'"))
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    state = common.full_state(spark, folder)
    return common.flat(views.delete_customers(state, _segment(state, "MACHINERY"), spec.NEW))


@registered(query("""
select 'old_customer' as "table", cast(CustomerId as varchar) as key, true as deleted, '' as content from all_customer where LastName = 'MACHINERY'
union all select 'old_invoice', cast(InvoiceId as varchar), true, '' from gone
union all select 'old_invoice_line', cast(InvoiceLineId as varchar), true, '' from all_line where InvoiceId in (select InvoiceId from gone)""",
    gone="select InvoiceId from all_invoice where CustomerId in (select CustomerId from all_customer where LastName = 'MACHINERY')"))
def cascade_delete_old(spark: SparkSession, folder: str) -> DataFrame:
    state = common.full_state(spark, folder)
    chosen = state["old_customer"].where("LastName = 'MACHINERY'").select("CustomerId")
    return common.flat(views.delete_customers(state, chosen, spec.OLD))


@registered(query("""
select 'new_invoice' as "table", InvoiceId as key, true as deleted, '' as content from full_new_invoice where Total > 400000
union all select 'new_invoice_line', InvoiceLineId, true, '' from full_new_line
  where InvoiceId in (select InvoiceId from full_new_invoice where Total > 400000)"""))
def invoice_delete(spark: SparkSession, folder: str) -> DataFrame:
    state = common.full_state(spark, folder)
    return common.flat(views.delete_invoices(state, state["new_invoice"].where("Total > 400000").select("InvoiceId"), spec.NEW))


@registered(query("""
select AddressId, sum(c) as customers, sum(i) as invoices from (
  select AddressId, 1 as c, 0 as i from full_new_customer union all select BillingAddressId, 0, 1 from full_new_invoice) x
where AddressId in (select AddressId from all_address where Country = 'ASIA') group by 1"""))
def restrict_violations(spark: SparkSession, folder: str) -> DataFrame:
    state = common.full_state(spark, folder)
    return views.restricted_addresses(state, state["new_address"].where("Country = 'ASIA'").select("AddressId"))


def _torn(state: State) -> State:
    """Some parents removed without their children."""
    return state.replace(
        new_address=state["new_address"].where("Country <> 'AFRICA'"),
        new_customer=state["new_customer"].where("LastName <> 'FURNITURE'"),
        new_invoice=state["new_invoice"].where("Total <= 450000"),
    )


@registered(query("""
select 'new_customer' as "table", CustomerId as key, 'AddressId' as "column", AddressId as missing from full_new_customer
  where LastName <> 'FURNITURE' and AddressId in (select AddressId from gone_address)
union all select 'new_invoice', InvoiceId, 'CustomerId', CustomerId from full_new_invoice
  where Total <= 450000 and CustomerId in (select CustomerId from full_new_customer where LastName = 'FURNITURE')
union all select 'new_invoice', InvoiceId, 'BillingAddressId', BillingAddressId from full_new_invoice
  where Total <= 450000 and BillingAddressId in (select AddressId from gone_address)
union all select 'new_invoice_line', InvoiceLineId, 'InvoiceId', InvoiceId from full_new_line
  where InvoiceId in (select InvoiceId from full_new_invoice where Total > 450000)
union all select 'map_address', """ + address_key(NEW, "exact") + """, 'AddressId', AddressId from gone_address""",
    gone_address="select * from all_address where Country = 'AFRICA'"))
def fk_violations(spark: SparkSession, folder: str) -> DataFrame:
    return views.foreign_key_violations(_torn(common.full_state(spark, folder)))


# Reconciliation -------------------------------------------------------------------------------------


def drifted(spark: SparkSession, folder: str) -> State:
    """All migrated, then both sides changed without telling the other."""
    state = common.full_state(spark, folder)
    return state.replace(
        new_customer=state["new_customer"].where("LastName <> 'FURNITURE'").withColumn(
            "Email", F.when(F.col("LastName") == "MACHINERY", F.upper("Email")).otherwise(F.col("Email"))),
        old_invoice=state["old_invoice"].where("Total <= 400000"),
        new_invoice=state["new_invoice"].withColumn(
            "Total", F.when(F.col("Total") < 50000, F.col("Total") + 1).otherwise(F.col("Total")).cast("decimal(18,2)")),
        new_address=state["new_address"].withColumn(
            "City", F.when(F.col("Country") == "ASIA", F.lower("City")).otherwise(F.col("City"))),
        new_invoice_line=state["new_invoice_line"].where("UnitPrice < 100000").withColumn(
            "Quantity", F.when(F.col("UnitPrice") > 90000, F.col("Quantity") + 1).otherwise(F.col("Quantity"))),
    )


_MISSING = """
select 'CUSTOMER' as entity, 'new' as missing_in, cast(OldId as varchar) as key from full_new_customer where LastName = 'FURNITURE'
union all select 'INVOICE', 'old', InvoiceId from full_new_invoice where Total > 400000
union all select 'INVOICELINE', 'new', cast(OldId as varchar) from full_new_line where UnitPrice >= 100000"""

_OLD_ROWS = f"select OldId as k, {', '.join(f'c.{o}' for o in OLD)}, c.Email, n.LastName, n.AddressId from all_customer c join full_new_customer n on n.OldId = c.CustomerId"
_CUSTOMER_DIFF = " union all ".join(
    [f"""select 'CUSTOMER' as entity, cast(k as varchar) as key, '{o}' as "column", x.{o} as old_value, a.{n} as new_value
        from old_rows x join new_addresses a on a.AddressId = x.AddressId where LastName <> 'FURNITURE' and x.{o} is distinct from a.{n}"""
     for o, n in zip(OLD, NEW)]
    + ["""select 'CUSTOMER', cast(k as varchar), 'Email', Email, upper(Email) from old_rows where LastName = 'MACHINERY'"""])
_INVOICE_DIFF = " union all ".join(
    [f"""select 'INVOICE', cast(i.InvoiceId as varchar), '{o}', i.{o}, a.{n} from all_invoice i join full_new_invoice f on f.OldId = i.InvoiceId
        join new_addresses a on a.AddressId = f.BillingAddressId where i.Total <= 400000 and i.{o} is distinct from a.{n}"""
     for o, n in zip(BILL, NEW)]
    + ["""select 'INVOICE', cast(InvoiceId as varchar), 'Total', cast(Total as varchar), cast(cast(Total + 1 as decimal(18,2)) as varchar)
         from all_invoice where Total < 50000"""])
_LINE_DIFF = """select 'INVOICELINE', cast(InvoiceLineId as varchar), 'Quantity', cast(Quantity as varchar), cast(Quantity + 1 as varchar)
    from all_line where UnitPrice > 90000 and UnitPrice < 100000"""
_DIFF = {
    "old_rows": _OLD_ROWS,
    "new_addresses": f"select AddressId, {', '.join(NEW)} from (select * replace (case when Country = 'ASIA' then lower(City) else City end as City) from all_address) d",
    "diffs": f"{_CUSTOMER_DIFF} union all {_INVOICE_DIFF} union all {_LINE_DIFF}",
    "missing": _MISSING,
}


@registered(query(_MISSING))
def reconcile_missing(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.all_missing_rows(drifted(spark, folder))


@registered(query("select * from diffs", **_DIFF))
def reconcile_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.all_mismatches(drifted(spark, folder))


@registered(query("""
select e.entity, e.checked, coalesce(mn, 0) as missing_in_new, coalesce(mo, 0) as missing_in_old, coalesce(d, 0) as mismatched,
  coalesce(mn, 0) + coalesce(mo, 0) + coalesce(d, 0) = 0 as holds
from (select 'CUSTOMER' as entity, count(*) as checked from all_customer union all select 'INVOICE', count(*) from all_invoice where Total <= 400000
      union all select 'INVOICELINE', count(*) from all_line) e
left join (select entity, count(*) filter (missing_in = 'new') as mn, count(*) filter (missing_in = 'old') as mo from missing group by 1) m on m.entity = e.entity
left join (select entity, count(distinct key) as d from diffs group by 1) x on x.entity = e.entity""", **_DIFF))
def reconcile_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.summary(drifted(spark, folder))


@registered(query("""
select 'INVOICE' as entity, 'new' as side, InvoiceId as key from full_new_invoice where Total > 400000
union all select 'INVOICE', 'old', cast(InvoiceId as varchar) from all_invoice where Total > 350000 and Total <= 400000
union all select 'INVOICE', 'new', InvoiceId from full_new_invoice where Total > 350000 and Total <= 400000"""))
def reconcile_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices above a total were to be deleted; the old side deleted part of them, the new side none."""
    state = drifted(spark, folder)
    deleted = common.full_state(spark, folder)["old_invoice"].where("Total > 350000").select(F.col("InvoiceId").alias("OldId"))
    return reconcile.still_present(state, spec.INVOICE, deleted)


@registered(query("""
select distinct 'customers by name' as "check", '{"FirstName":"' || FirstName || '"}' as value from full_new_customer where LastName = 'FURNITURE'
union all select distinct 'addresses by street and city', '{"Address":"' || Address || '","City":"' || City || '"}' from all_customer
  where Address || '|' || City not in (select Street || '|' || City from new_addresses)""", **_DIFF))
def reconcile_by_value(spark: SparkSession, folder: str) -> DataFrame:
    state = drifted(spark, folder)
    names = reconcile.missing_by_value(
        state["old_customer"], state["new_customer"], {"FirstName": "FirstName"}, "customers by name")
    streets = reconcile.missing_by_value(
        state["old_customer"], state["new_address"], {"Address": "Street", "City": "City"}, "addresses by street and city")
    return names.unionByName(streets)


# Timeline and logs ---------------------------------------------------------------------------------


def _outbox(spark: SparkSession, folder: str, condition: str, kind: str) -> DataFrame:
    events = tpch.table(spark, folder, "events").where(condition)
    return events.select(
        "event_id", F.col("user_id").alias("aggregate_id"), F.lit(kind).alias("aggregate_type"), "event_type",
        F.col("props").alias("payload"), F.md5(F.col("event_id").cast("string")).alias("unique_identifier"),
        tpch.utc("ts").alias("created_at"))


@registered("""
select case when event_type = 'error' then 'NEW' else 'OLD' end as "SourceDatabase",
  case event_type when 'purchase' then 'invoice_outbox' when 'click' then 'invoiceline_outbox' when 'error' then 'AddressOutbox' else 'customer_outbox' end as "SourceTable",
  cast(event_id as varchar) as "EventId", cast(user_id as varchar) as "AggregateId",
  case event_type when 'purchase' then 'INVOICE' when 'click' then 'INVOICELINE' when 'error' then 'ADDRESS' else 'CUSTOMER' end as "AggregateType",
  event_type as "EventType", props as "Payload", md5(cast(event_id as varchar)) as "UniqueIdentifier", epoch_us(ts) as "CreatedAt"
from events""")
def event_timeline(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    old = outbox.side_entries({
        "customer_outbox": _outbox(spark, folder, "event_type in ('signup', 'view')", "CUSTOMER"),
        "invoice_outbox": _outbox(spark, folder, "event_type = 'purchase'", "INVOICE"),
        "invoiceline_outbox": _outbox(spark, folder, "event_type = 'click'", "INVOICELINE"),
    }, "OLD")
    new = outbox.side_entries({"AddressOutbox": _outbox(spark, folder, "event_type = 'error'", "ADDRESS")}, "NEW")
    return outbox.timeline(old, new).withColumn("CreatedAt", F.unix_micros("CreatedAt"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One log line per event; the level follows from the event's type and value."""
    configure(spark)
    level = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 50), "[FATAL]")
        .when((F.col("event_type") == "error") & (F.col("value") > 20), "[FTL]")
        .when(F.col("event_type") == "error", "ERROR").otherwise("[INF]"))
    return tpch.table(spark, folder, "events").select(
        F.concat_ws(" ", F.col("event_id").cast("string"), level, F.col("event_type"), F.col("props")).alias("value"))


_LOG = {"log": """select event_type, case when event_type <> 'error' then '[INF]' when value > 50 then '[FATAL]' when value > 20 then '[FTL]' else 'ERROR' end as level,
    event_id, props from events"""}


@registered(query("""
select count(*) as lines, count(*) filter (level = 'ERROR') as errors, count(*) filter (level in ('[FATAL]', '[FTL]')) as fatal,
  count(*) filter (level <> '[INF]') as problems, count(*) filter (level <> '[INF]') = 0 as healthy from log""", **_LOG))
def log_health(spark: SparkSession, folder: str) -> DataFrame:
    return logs.log_health(log_lines(spark, folder))


@registered(query("""
select cast(event_id as varchar) || ' ' || level || ' ' || event_type || ' ' || props as value from log where level in ('[FATAL]', '[FTL]')""", **_LOG))
def fatal_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return logs.fatal_lines(log_lines(spark, folder))


_STATUS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@registered(" union all ".join(f"select '{t}' as \"table\", count(*) as rows, count(*) > 0 as has_data from {t}" for t in _STATUS))
def table_status(spark: SparkSession, folder: str) -> DataFrame:
    return views.table_status({t: tpch.table(spark, folder, t) for t in _STATUS})


# Mutations -------------------------------------------------------------------------------------------


@registered(query(f"""
select CustomerId, FirstName, LastName, {', '.join(OLD)}, Phone, Email from all_customer
union all select max(CustomerId) + 1, 'Ann', 'Example', 'First Street 1', 'Town', null, 'EUROPE', '1', null, 'ann@example.com' from all_customer"""))
def insert_from_subquery(spark: SparkSession, folder: str) -> DataFrame:
    values = {
        "FirstName": F.lit("Ann"), "LastName": F.lit("Example"), "Address": F.lit("First Street 1"), "City": F.lit("Town"),
        "Country": F.lit("EUROPE"), "PostalCode": F.lit("1"), "Email": F.lit("ann@example.com"),
    }
    return mutate.insert_with_next_key(common.old_state(spark, folder)["old_customer"], "CustomerId", values)


@registered(query("""
select InvoiceId, CustomerId, Total from all_invoice
union all select (select max(InvoiceId) + 1 from all_invoice), (select min(CustomerId) from all_customer where Email like '%@example.com' and Country = 'ASIA'), 12.5"""))
def insert_invoice_by_email(spark: SparkSession, folder: str) -> DataFrame:
    """The new invoice's customer is found by a subquery over the customers."""
    state = common.old_state(spark, folder)
    owner = mutate.id_of(state["old_customer"], "CustomerId", F.col("Email").like("%@example.com") & (F.col("Country") == "ASIA"))
    rows = state["old_invoice"].select("InvoiceId", "CustomerId", "Total")
    return mutate.insert_with_next_key(rows, "InvoiceId", {"CustomerId": owner, "Total": F.lit(12.5)})


@registered(query("""
select InvoiceId, cast(null as varchar) as TestColumn, true as in_range, Total from all_invoice"""))
def add_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A null column, and a random decimal of which only the range can be compared."""
    rows = common.old_state(spark, folder)["old_invoice"]
    changed = mutate.add_random_decimal(mutate.add_nullable_column(rows, "TestColumn"), "TestValue3", 3, seed=42)
    return changed.select("InvoiceId", "TestColumn", F.col("TestValue3").between(0, 1000).alias("in_range"), "Total")


@registered(query(f"""
select {surrogate('customer', 'CustomerId')} as CustomerId, FirstName,
  case when LastName = 'BUILDING' then 'new@example.com' else Email end as Email,
  case when a.AddressId in (select AddressId from full_new_customer where LastName = 'BUILDING') then 'EUROPE' else a.Country end as Country,
  case when a.City = 'NATION_3' then 'NATION_THREE' else a.City end as City
from (select OldId as CustomerId, FirstName, LastName, AddressId, Email from full_new_customer where LastName <> 'HOUSEHOLD') c
join all_address a on a.AddressId = c.AddressId"""))
def targeted_mutations(spark: SparkSession, folder: str) -> DataFrame:
    """City, email, country through the address, and a deletion, as the integration scenario does them."""
    state = common.full_state(spark, folder)
    customers = mutate.update_where(
        state["new_customer"], F.col("LastName") == "BUILDING", {"Email": F.lit("new@example.com")})
    chosen = state["new_customer"].where("LastName = 'BUILDING'").select("AddressId")
    addresses = mutate.update_through(state["new_address"], "AddressId", chosen, {"Country": F.lit("EUROPE")})
    addresses = mutate.update_where(addresses, F.col("City") == "NATION_3", {"City": F.lit("NATION_THREE")})
    kept = mutate.delete_where(customers, F.col("LastName") == "HOUSEHOLD")
    return kept.join(addresses, "AddressId").select("CustomerId", "FirstName", "Email", "Country", "City")


@registered(query("""
select InvoiceLineId, InvoiceId, TrackId, UnitPrice, case when InvoiceLineId in (select m from firsts) then 99 else Quantity end as Quantity from all_line""",
    firsts="select min(InvoiceLineId) as m from all_line where Quantity = 1 group by InvoiceId"))
def first_line_update(spark: SparkSession, folder: str) -> DataFrame:
    """The quantity of each invoice's first single-piece line."""
    lines = common.old_state(spark, folder)["old_invoice_line"]
    first = lines.where("Quantity = 1").groupBy("InvoiceId").agg(F.min("InvoiceLineId").alias("InvoiceLineId"))
    return mutate.update_through(lines, "InvoiceLineId", first, {"Quantity": F.lit(99)}).select(
        "InvoiceLineId", "InvoiceId", "TrackId", "UnitPrice", "Quantity")


@registered(query("""
select InvoiceId, min(InvoiceLineId) as InvoiceLineId from all_line where UnitPrice = (select min(UnitPrice) from all_line) group by 1"""))
def first_line_with_price(spark: SparkSession, folder: str) -> DataFrame:
    lines = common.full_state(spark, folder)["old_invoice_line"]
    return views.first_line_with_price(lines, lines.agg(F.min("UnitPrice")).scalar())
