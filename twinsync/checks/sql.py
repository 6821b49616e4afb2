"""The same states and change streams in SQL, as named common table expressions.

Each entry may use the ones above it; ``query`` puts those that a statement needs in
front of it.
"""

from __future__ import annotations

import re

from twinsync import spec


def _part(column: str, mode: str, optional: bool) -> str:
    if mode == "exact":
        value = column
    elif mode == "ignore_case":
        value = f"upper(coalesce({column}, ''))"
    elif mode == "trim_upper":
        value = f"coalesce(upper(trim({column})), '')"
    else:
        value = f"upper(trim({column}))"
        value = f"nullif({value}, '')" if optional else value
    return f"coalesce(cast(length({value}) as varchar) || ':' || {value}, '-')"


def address_key(columns: list[str], mode: str, prefix: str = "") -> str:
    parts = [_part(prefix + c, mode, i in (2, 4)) for i, c in enumerate(columns)]
    return f"concat_ws('|', {', '.join(parts)})"


def surrogate(entity: str, *parts: str) -> str:
    texts = ", ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    return f"md5(concat_ws('|', '{entity}', {texts}))"


def text(*columns: str) -> str:
    """Columns as one text, nulls visible."""
    return "concat_ws('|', " + ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in columns) + ")"


OLD, NEW, BILL = spec.OLD_ADDRESS, spec.NEW_ADDRESS, spec.BILLING_ADDRESS
ZERO = spec.ZERO_KEY


def _columns(prefix: str, columns: list[str], names: list[str] | None = None) -> str:
    return ", ".join(f"{prefix}{c} as {n}" for c, n in zip(columns, names or columns))


CTES: dict[str, str] = {}

CTES["all_customer"] = """
select c_custkey as CustomerId, c_name as FirstName, c_mktsegment as LastName,
       case when c_custkey % 7 = 0 then upper(lower(c_mktsegment) || ' street') else lower(c_mktsegment) || ' street' end as Address,
       n_name as City, case when c_custkey % 3 <> 0 then r_name end as State, r_name as Country,
       case when c_custkey % 5 <> 0 then lpad(cast(c_nationkey as varchar), 5, '0') end as PostalCode,
       cast(null as varchar) as Phone, lower(c_name) || '@example.com' as Email, c_acctbal
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

CTES["all_invoice"] = """
select o_orderkey as InvoiceId, o_custkey as CustomerId, o_orderdate as InvoiceDate,
       case when o_orderkey % 11 = 0 then Address || ' annex' else Address end as BillingAddress, City as BillingCity,
       State as BillingState, Country as BillingCountry, PostalCode as BillingPostalCode,
       cast(o_totalprice as decimal(18,2)) as Total, o_orderstatus, o_orderpriority
from orders join all_customer on o_custkey = CustomerId"""

CTES["all_line"] = """
select row_number() over (order by md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
         cast(l_partkey as varchar), cast(l_suppkey as varchar), cast(cast(l_quantity as decimal(18,2)) as varchar),
         cast(cast(l_extendedprice as decimal(18,2)) as varchar), cast(cast(l_discount as decimal(18,2)) as varchar),
         cast(cast(l_tax as decimal(18,2)) as varchar), l_returnflag, l_linestatus,
         cast(cast(epoch(l_shipdate) as bigint) as varchar)))) as InvoiceLineId,
       l_orderkey as InvoiceId, l_partkey as TrackId, cast(l_extendedprice as decimal(18,2)) as UnitPrice,
       cast(l_quantity as integer) as Quantity, l_returnflag, l_linestatus
from lineitem"""

CTES["all_address"] = f"""
select MatchKey, {surrogate('address', 'MatchKey')} as AddressId, {', '.join(NEW)}, r as rank from (
  select *, {address_key(NEW, 'ignore_case')} as MatchKey,
         row_number() over (partition by {address_key(NEW, 'ignore_case')} order by r) as n
  from (select {_columns('', OLD, NEW)}, CustomerId as r from all_customer
        union all select {_columns('', BILL, NEW)}, InvoiceId + 4611686018427387904 from all_invoice) u) v
where n = 1"""

# The whole old schema migrated ---------------------------------------------------------

CTES["full_new_customer"] = f"""
select CustomerId as OldId, {surrogate('customer', 'CustomerId')} as CustomerId, FirstName, LastName, AddressId, Phone, Email
from all_customer c join all_address a on {address_key(OLD, 'ignore_case', 'c.')} = a.MatchKey"""
CTES["full_new_invoice"] = f"""
select InvoiceId as OldId, CustomerId as OldCustomerId, {surrogate('invoice', 'InvoiceId')} as InvoiceId,
       {surrogate('customer', 'CustomerId')} as CustomerId, InvoiceDate, AddressId as BillingAddressId, Total,
       cast(0 as decimal(18,3)) as TestValue3
from all_invoice i join all_address a on {address_key(BILL, 'ignore_case', 'i.')} = a.MatchKey"""
CTES["full_new_line"] = f"""
select InvoiceLineId as OldId, InvoiceId as OldInvoiceId, {surrogate('invoiceline', 'InvoiceLineId')} as InvoiceLineId,
       {surrogate('invoice', 'InvoiceId')} as InvoiceId, TrackId, UnitPrice, Quantity from all_line"""

# What is migrated before the change stream starts ------------------------------------------

CTES["base_customer"] = "select * from all_customer where LastName <> 'BUILDING'"
CTES["base_invoice"] = """
select * from all_invoice where o_orderstatus <> 'O' and CustomerId in (select CustomerId from base_customer)"""
CTES["base_line"] = """
select * from all_line where l_returnflag <> 'N' and InvoiceId in (select InvoiceId from base_invoice)"""
CTES["base_address"] = f"""
select MatchKey, {surrogate('address', 'MatchKey')} as AddressId, {', '.join(NEW)} from (
  select *, {address_key(NEW, 'ignore_case')} as MatchKey,
         row_number() over (partition by {address_key(NEW, 'ignore_case')} order by r) as n
  from (select {_columns('', OLD, NEW)}, CustomerId as r from base_customer
        union all select {_columns('', BILL, NEW)}, InvoiceId + 4611686018427387904 from base_invoice) u) v
where n = 1"""
CTES["base_map_address"] = f"select *, {address_key(NEW, 'exact')} as AddressKey from base_address"
CTES["base_new_customer"] = f"""
select CustomerId as OldId, {surrogate('customer', 'CustomerId')} as CustomerId, FirstName, LastName, AddressId, Phone, Email
from base_customer c join base_address a on {address_key(OLD, 'ignore_case', 'c.')} = a.MatchKey"""
CTES["base_new_invoice"] = f"""
select InvoiceId as OldId, {surrogate('invoice', 'InvoiceId')} as InvoiceId, {surrogate('customer', 'CustomerId')} as CustomerId,
       InvoiceDate, AddressId as BillingAddressId, Total, cast(0 as decimal(18,3)) as TestValue3
from base_invoice i join base_address a on {address_key(BILL, 'ignore_case', 'i.')} = a.MatchKey"""
CTES["base_new_line"] = f"""
select InvoiceLineId as OldId, {surrogate('invoiceline', 'InvoiceLineId')} as InvoiceLineId,
       {surrogate('invoice', 'InvoiceId')} as InvoiceId, TrackId, UnitPrice, Quantity from base_line"""

# Edits on the new side ----------------------------------------------------------------------

CTES["edited_address"] = """
select AddressId, case when lower(Street) like 'machinery%' then Street || ' edited' else Street end as Street,
       City, State, Country, PostalCode from all_address"""
CTES["edited_new_customer"] = f"""
select CustomerId, AddressId from base_new_customer
union all
select {surrogate('customer', 'CustomerId')}, AddressId
from all_customer c join all_address a on {address_key(OLD, 'ignore_case', 'c.')} = a.MatchKey where LastName = 'BUILDING'"""

# Change streams ------------------------------------------------------------------------------

CTES["customer_changes"] = """
select *, md5('customer|' || cast(seq as varchar)) as unique_identifier from (
  select event_id as seq,
         case when event_type = 'signup' then 'c' when event_type = 'view' then 'u'
              when event_type = 'error' and k >= 97 then 'd' end as op,
         CustomerId, FirstName, LastName,
         case when k % 2 = 0 then Address else lower(LastName) || ' avenue' end as Address, City, State, Country, PostalCode,
         'p' || cast(k % 10 as varchar) as Phone, Email
  from (select *, cast(regexp_replace(props, '[^0-9]', '', 'g') as bigint) as k from events) e
  join all_customer on user_id = CustomerId) x
where op is not null"""

_INVOICE_STEPS = """(values ('c', 0), ('u', 1), ('d', 2)) as e(op, step)
where (op = 'c' and (o_orderstatus = 'O' or o_orderpriority = '5-LOW'))
   or (op = 'u' and (o_orderstatus = 'P' or o_orderpriority = '1-URGENT'))
   or (op = 'd' and o_orderpriority = '2-HIGH')"""
CTES["invoice_changes"] = f"""
select InvoiceId * 3 + step as seq, md5('invoice|' || cast(InvoiceId * 3 + step as varchar)) as unique_identifier, op,
       InvoiceId, CustomerId, InvoiceDate,
       case when op = 'u' and o_orderpriority = '3-MEDIUM' then BillingCity || ' plaza' else BillingAddress end as BillingAddress,
       BillingCity, BillingState, BillingCountry, BillingPostalCode, cast(Total + step as decimal(18,2)) as Total
from all_invoice, {_INVOICE_STEPS}"""
_LINE_STEPS = """(values ('c', 0), ('u', 1), ('d', 2)) as e(op, step)
where (op = 'c' and (l_returnflag = 'N' or (l_returnflag = 'R' and l_linestatus = 'O')))
   or (op = 'u' and (l_returnflag = 'A' or (l_returnflag = 'N' and l_linestatus = 'F')))
   or (op = 'd' and l_returnflag = 'R' and l_linestatus = 'F')"""
CTES["line_changes"] = f"""
select InvoiceLineId * 3 + step as seq, md5('line|' || cast(InvoiceLineId * 3 + step as varchar)) as unique_identifier, op,
       InvoiceLineId, InvoiceId, TrackId, UnitPrice, Quantity + step as Quantity
from all_line, {_LINE_STEPS}"""
CTES["new_customer_changes"] = f"""
select CustomerId * 3 + step as seq, md5('new customer|' || cast(CustomerId * 3 + step as varchar)) as unique_identifier, op,
       CustomerId as OldId, {surrogate('customer', 'CustomerId')} as CustomerId, FirstName, LastName,
       case when c_acctbal < 100 then '{ZERO}' else AddressId end as AddressId, 'q' || cast(step as varchar) as Phone, Email
from all_customer c join all_address a on {address_key(OLD, 'ignore_case', 'c.')} = a.MatchKey,
     (values ('c', 0), ('u', 1), ('d', 2)) as e(op, step)
where (op = 'c' and LastName in ('BUILDING', 'FURNITURE'))
   or (op = 'u' and LastName in ('MACHINERY', 'AUTOMOBILE', 'BUILDING'))
   or (op = 'd' and LastName = 'HOUSEHOLD')"""
CTES["new_address_changes"] = """
select rank as seq, md5('address|' || cast(rank as varchar)) as unique_identifier, op, AddressId,
       trim(Street || case when op = 'u' then ' moved' else '' end) as Street,
       case when Country = 'ASIA' then '' else City end as City, State, Country, PostalCode
from (select *, case Country when 'AFRICA' then 'c' when 'AMERICA' then 'd' else 'u' end as op from all_address) a"""
CTES["new_invoice_changes"] = f"""
select InvoiceId * 3 + step as seq, md5('new invoice|' || cast(InvoiceId * 3 + step as varchar)) as unique_identifier, op,
       InvoiceId as OldId, {surrogate('invoice', 'InvoiceId')} as InvoiceId, CustomerId as OldCustomerId, InvoiceDate,
       cast(Total + step as decimal(18,2)) as Total
from all_invoice, {_INVOICE_STEPS}"""
CTES["new_line_changes"] = f"""
select InvoiceLineId * 3 + step as seq, md5('new line|' || cast(InvoiceLineId * 3 + step as varchar)) as unique_identifier, op,
       InvoiceLineId as OldId, {surrogate('invoiceline', 'InvoiceLineId')} as InvoiceLineId, InvoiceId as OldInvoiceId,
       TrackId, UnitPrice, Quantity + step as Quantity
from all_line, {_LINE_STEPS}"""

# Events of the streaming checks -----------------------------------------------------------------

CTES["cdc_event"] = """
select event_id as seq, ts as created_ts,
       case event_type when 'signup' then 'CUSTOMER' when 'view' then 'CUSTOMER' when 'purchase' then 'INVOICE'
            when 'click' then 'INVOICELINE' else case when event_id % 4 < 2 then '' else 'CUSTOMER' end end as aggregate_type,
       case event_type when 'view' then 'UPDATED' else 'CREATED' end as event_type,
       case event_type when 'purchase' then event_id when 'click' then event_id + (json_k % 5) - 2 else user_id end as aggregate_id,
       user_id,
       case when event_type = 'error' and event_id % 4 = 0 then 'true'
            when event_type = 'error' and event_id % 4 = 1 then 'last' end as snapshot,
       case when event_type = 'error' and event_id % 4 = 2 then 'r' when event_type = 'view' then 'u' else 'c' end as op,
       case when event_type = 'error' and event_id % 4 = 3 then md5(cast(event_id - 1 as varchar))
            else md5(cast(event_id as varchar)) end as unique_identifier, json_k
from (select *, cast(regexp_replace(props, '[^0-9]', '', 'g') as bigint) as json_k from events) e"""
CTES["live"] = "select * from cdc_event where snapshot is null and op <> 'r'"


def query(statement: str, **extra: str) -> str:
    """The statement with the table expressions it needs in front of it.

    ``extra`` adds expressions of this query only, in order; they may use each other.
    """
    known = {**CTES, **extra}
    order = list(known)
    wanted: set[str] = set()

    def need(sql: str) -> None:
        for name in set(re.findall(r"\w+", sql)):
            if name in known and name not in wanted and known[name] is not sql:
                wanted.add(name)
                need(known[name])

    need(statement)
    ctes = ",\n".join(f"{n} as ({known[n].strip()})" for n in order if n in wanted)
    return f"with {ctes}\n{statement.strip()}" if ctes else statement.strip()


def lifecycle(events: str, update_without_row: str = "skip:row_missing") -> dict[str, str]:
    """Outcome of every event of ``events`` (key, seq, op, problem, mapped, present) as ``life``."""
    return {
        "life0": f"select *, min(case when op = 'c' and problem is null then seq end) over (partition by key) as born from ({events}) e",
        "life1": """select *, case when mapped then -1 else born end as mapped_from,
                    case when mapped then (case when present then -1 end) else born end as alive_from from life0""",
        "life2": "select *, min(case when op = 'd' and seq > alive_from then seq end) over (partition by key) as dies from life1",
        "life": f"""select *,
            case when op = 'c' then case when not mapped and seq = born then 'applied'
                                         when seq > mapped_from then 'skip:already_mapped' else problem end
                 when mapped_from is null or seq <= mapped_from
                   then case when op = 'u' then 'dead:mapping_missing' else 'skip:not_mapped' end
                 when alive_from is null or seq <= alive_from or (dies is not null and seq > dies)
                   then case when op = 'u' then '{update_without_row}' else 'skip:row_missing' end
                 when op = 'u' and problem is not null then problem
                 else 'applied' end as outcome
            from life2""",
        "applied": "select * from life where outcome = 'applied'",
        "written": "select * from applied where op in ('c', 'u')",
        "last_image": "select * from (select *, row_number() over (partition by key order by seq desc) as n from written) w where n = 1",
        "first_image": "select * from (select *, row_number() over (partition by key order by seq) as n from written) w where n = 1",
        "born_key": "select key, seq from applied where op = 'c'",
        "dead_key": "select key from applied where op = 'd'",
    }


def outcome_rows() -> str:
    return "select 'outcome' as \"table\", cast(seq as varchar) as key, false as deleted, op || '|' || outcome as content from life"


def processed_rows(side: str) -> str:
    return f"select distinct 'processed_{side}', unique_identifier, false, '' from applied"
