"""Decoding, filtering, classification, gate, order and stream plumbing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.checks import common
from twinsync.checks.sql import query
from twinsync.functions.convert import decimal_from_base64
from twinsync.functions.envelope import decode_envelope, is_snapshot_true, outer_aggregate_id
from twinsync.functions.payload import typed_events
from twinsync.operators import classify, filters
from twinsync.operators.gate import gate, hold_and_release
from twinsync.operators.order import batch_summary, dependency_order
from twinsync.operators.state import State
from twinsync.session import configure, cut
from twinsync.sources import streams, tpch

ORACLES: dict[str, str] = {}

# Decoding -----------------------------------------------------------------------------


def envelope_decode(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    decoded = decode_envelope(tpch.cdc_json(spark, folder))
    timed = F.col("disposition").isin("dead:bad_json", "dead:bad_time")
    return decoded.select(
        "seq", "disposition", "entity", "event_type", "op", "aggregate_id", "source", "source_table",
        "unique_identifier", "payload", F.when(~timed, F.unix_millis("event_time")).alias("event_ms"),
        is_snapshot_true(F.col("snapshot")).alias("snapshot_true"), outer_aggregate_id(F.col("value")).alias("outer_id"),
    )


ORACLES["envelope_decode"] = query("""
select seq,
  case when snap then 'skip:snapshot' when bad then 'dead:bad_json' when no_time then 'dead:bad_time'
       when no_op then 'skip:no_op' when op = 'r' then 'skip:read' when seq % 97 <> 0 and seq % 101 = 0 then 'dead:unknown_op'
       when seq % 107 = 0 or seq % 109 = 0 then 'dead:unknown_source' else 'apply' end as disposition,
  case when snap then '' when bad then 'MISSING_EVENT_TYPE' when seq % 13 = 0 then lower(aggregate_type) else aggregate_type end as entity,
  case when none then '' else kind end as event_type,
  case when snap then null when bad then null when kind = '' then (case when no_op then null else op end)
       when kind = 'TRUNCATED' then null when kind = 'UPDATED' then 'u' else 'c' end as op,
  case when snap then '' when bad then 'MISSING_AGGREGATE_ID' else cast(aggregate_id as varchar) end as aggregate_id,
  case when snap then '' when bad or seq % 107 = 0 then null when seq % 109 = 0 then 'elsewhere' else 'old_to_new' end as source,
  case when none then '' when aggregate_type = 'INVOICELINE' then 'invoiceline_outbox' when aggregate_type = 'INVOICE' then 'invoice_outbox'
       else 'customer_outbox' end as source_table,
  case when none then null else unique_identifier end as unique_identifier,
  case when none then null
       when aggregate_type = 'INVOICELINE' then '{"InvoiceLineId":' || seq || ',"invoiceid":' || aggregate_id || '}'
       when aggregate_type = 'INVOICE' then '{"InvoiceId":' || aggregate_id || ',"CustomerId":"' || user_id || '"}'
       else '{"CustomerId":' || aggregate_id || ',"FirstName":"user"}' end as payload,
  case when not bad and not no_time then epoch_us(created_ts) // 1000 end as event_ms,
  coalesce(snapshot = 'true', false) as snapshot_true,
  case when none then '' else ' ' || cast(aggregate_id as varchar) end as outer_id
from shaped""",
    shaped="""select *, snap or bad as none,
        not snap and not bad and seq % 17 <> 0 and seq % 103 = 0 as no_time,
        not snap and not bad and seq % 89 = 0 as no_op,
        case when seq % 97 = 0 then '' when seq % 101 = 0 then 'TRUNCATED' else event_type end as kind
        from (select *, snapshot is not null as snap, snapshot is null and seq % 113 = 0 as bad from cdc_event) e""",
)


def payload_typed_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Invoice payloads with every form of number and date, and some that cannot be converted."""
    configure(spark)
    orders = tpch.table(spark, folder, "orders")
    key, moment = F.col("o_orderkey"), tpch.utc("o_orderdate")
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    digits = F.hex(cents)
    whole = F.base64(F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)))
    total = (
        F.when(key % 3 == 0, F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("5")))
        .when(key % 3 == 1, F.concat(F.lit('"'), whole, F.lit('"')))
        .when(key % 19 == 2, F.lit('"not base64!"'))
        .otherwise(F.lit("null"))
    )
    date = (
        F.when(key % 4 == 0, F.concat(F.lit('"'), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit('.000000"')))
        .when(key % 4 == 1, F.concat(F.lit('"'), F.date_format(moment, "yyyy-MM-dd"), F.lit('"')))
        .otherwise(F.unix_millis(moment).cast("string"))
    )
    value = F.concat(
        F.lit('{"InvoiceId":'), key, F.lit(',"CustomerId":"'), F.col("o_custkey"), F.lit('","InvoiceDate":'), date,
        F.lit(',"Unknown":[1],"BillingCity":"'), F.col("o_orderpriority"), F.lit('","Total":'), total, F.lit("}"))
    events = orders.select(
        key.alias("seq"), F.md5(key.cast("string")).alias("unique_identifier"), F.lit("c").alias("op"), value.alias("payload"))
    typed = typed_events(events, spec.OLD, spec.INVOICE)
    return typed.select(
        "seq", "InvoiceId", "CustomerId", F.unix_millis("InvoiceDate").alias("InvoiceDate"), "BillingCity", "BillingState",
        "Total", "payload_problem")


ORACLES["payload_typed_decode"] = query("""
select o_orderkey as seq, o_orderkey as InvoiceId, o_custkey as CustomerId, epoch_ms(o_orderdate) as InvoiceDate,
  o_orderpriority as BillingCity, cast(null as varchar) as BillingState,
  cast(case when o_orderkey % 3 = 0 then total + cast(cents % 2 as decimal(18,2)) * 0.01 when o_orderkey % 3 = 1 then total end
    as decimal(18,2)) as Total,
  case when o_orderkey % 3 = 2 and o_orderkey % 19 = 2 then 'dead:bad_payload' end as payload_problem
from (select *, cast(o_totalprice as decimal(18,2)) as total, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as cents
      from orders) o""")


def decimal_base64(spark: SparkSession, folder: str) -> DataFrame:
    """Totals as unscaled cents, and the same shifted by eight bytes, which needs more than 64 bits."""
    configure(spark)
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    digits = F.lpad(F.hex(cents), 14, "0")
    small, wide = F.base64(F.unhex(digits)), F.base64(F.unhex(F.concat(digits, F.lit("0" * 16))))
    return tpch.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("InvoiceId"),
        decimal_from_base64(small, 2).cast("string").alias("small"),
        decimal_from_base64(small, 0).cast("string").alias("whole"),
        decimal_from_base64(wide, 0).cast("string").alias("wide"),
    )


ORACLES["decimal_base64"] = """
select o_orderkey as "InvoiceId", cast(cast(o_totalprice as decimal(18,2)) as varchar) as small,
  cast(cents as varchar) as whole, cast(cast(cents as hugeint) * 18446744073709551616 as varchar) as wide
from (select *, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as cents from orders) o"""

# Filters --------------------------------------------------------------------------------


def _raw_events(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return tpch.cdc_event(spark, folder).withColumnRenamed("op", "op_marker")


def filter_pipeline_events(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots, reads, repeats and processed events out; users 0-9 were processed on the old, errors on the new side."""
    events = _raw_events(spark, folder)
    table = tpch.table(spark, folder, "events").withColumn("unique_identifier", F.md5(F.col("event_id").cast("string")))
    state = State(spark, {
        "processed_old": table.where("user_id < 10").select("unique_identifier"),
        "processed_new": table.where("value > 100").select("unique_identifier"),
    })
    kept = filters.unprocessed(filters.changes_only(filters.without_snapshots(events)), state)
    return filters.first_of_identifier(kept).select("seq", "aggregate_type", "op_marker", "unique_identifier")


ORACLES["filter_pipeline_events"] = query("""
select seq, aggregate_type, op as op_marker, unique_identifier from (
  select *, row_number() over (partition by unique_identifier order by seq) as n from live
  where unique_identifier not in (select md5(cast(event_id as varchar)) from events where user_id < 10 or value > 100)) x
where n = 1""")


def snapshot_progress(spark: SparkSession, folder: str) -> DataFrame:
    return filters.snapshot_finished(_raw_events(spark, folder))


ORACLES["snapshot_progress"] = query("select coalesce(bool_or(snapshot = 'last'), false) as finished from cdc_event")


def echo_suppression(spark: SparkSession, folder: str) -> DataFrame:
    state = common.base_state(spark, folder)
    events = common.invoice_changes(spark, folder)
    return filters.without_echoes(events, state, spec.INVOICE, spec.NEW).select("seq", "op", "InvoiceId")


ORACLES["echo_suppression"] = query("""
select seq, op, InvoiceId from invoice_changes where op <> 'c' or InvoiceId not in (select InvoiceId from base_invoice)""")


def route_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events spread over both directions, all tables and one that does not exist."""
    configure(spark)
    events = tpch.table(spark, folder, "events")
    kind = F.col("event_type")
    new_side = F.col("user_id") % 2 == 0
    old_table = F.when(kind == "purchase", "invoice_outbox").when(kind == "click", "invoiceline_outbox").when(
        kind == "error", "track_outbox").otherwise("customer_outbox")
    new_table = F.when(kind == "purchase", "InvoiceOutbox").when(kind == "click", "InvoiceLineOutbox").when(
        kind == "error", "AddressOutbox").otherwise("CustomerOutbox")
    op = F.when(F.col("value") < 10, "c").when(F.col("value") < 20, "u").otherwise("d")
    return filters.routed(events.select(
        F.col("event_id").alias("seq"),
        F.when(new_side, spec.NEW_TO_OLD).otherwise(spec.OLD_TO_NEW).alias("source"),
        F.when(new_side, new_table).otherwise(old_table).alias("source_table"), op.alias("op"),
    )).select("seq", "route", "handled")


ORACLES["route_events"] = """
select seq, route, route not like '%track%' and route <> 'new_to_old_AddressOutbox_d' as handled from (
  select event_id as seq,
    case when user_id % 2 = 0 then 'new_to_old_' ||
        case event_type when 'purchase' then 'InvoiceOutbox' when 'click' then 'InvoiceLineOutbox' when 'error' then 'AddressOutbox' else 'CustomerOutbox' end
      else 'old_to_new_' ||
        case event_type when 'purchase' then 'invoice_outbox' when 'click' then 'invoiceline_outbox' when 'error' then 'track_outbox' else 'customer_outbox' end
    end || case when value < 10 then '_c' when value < 20 then '_u' else '_d' end as route
  from events) e"""


def noop_suppression(spark: SparkSession, folder: str) -> DataFrame:
    """Images of all customers; only those of two segments differ from the stored rows, BUILDING is not stored."""
    configure(spark)
    stored = tpch.old_customer(spark, folder).where("LastName <> 'BUILDING'")
    email = F.when(F.col("LastName") == "HOUSEHOLD", F.upper("Email")).otherwise(F.col("Email"))
    state = F.when(F.col("LastName") == "FURNITURE", F.coalesce("State", F.lit("none"))).otherwise(F.col("State"))
    images = tpch.old_customer(spark, folder).withColumn("Email", email).withColumn("State", state)
    columns = [c for c in images.columns if c != "CustomerId"]
    return filters.without_noops(images, stored, "CustomerId", columns).select("CustomerId", "Email", "State")


ORACLES["noop_suppression"] = query("""
select CustomerId, case when LastName = 'HOUSEHOLD' then upper(Email) else Email end as Email,
  case when LastName = 'FURNITURE' then coalesce(State, 'none') else State end as State from all_customer
where LastName in ('BUILDING', 'HOUSEHOLD') or (LastName = 'FURNITURE' and State is null)""")

# Dependencies ------------------------------------------------------------------------------


def priority_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event's type, in mixed case, with a type no group knows."""
    events = _raw_events(spark, folder)
    type_ = F.when(F.col("aggregate_type") == "", "Track").when(
        F.col("seq") % 3 == 0, F.lower("aggregate_type")).when(F.col("user_id") % 5 == 0, "address").otherwise(F.col("aggregate_type"))
    group, element = classify.priority(F.col("type"))
    return events.select("seq", type_.alias("type")).select(
        "seq", "type", group.alias("group_index"), element.alias("element_index"),
        classify.dependency_type(F.col("type")).alias("depends_on"), classify.is_dependent(F.col("type")).alias("dependent"),
        classify.is_cached(F.col("type")).alias("cached"))


ORACLES["priority_lookup"] = query("""
select seq, t.type, coalesce(g, 2147483647) as group_index, coalesce(e, 2147483647) as element_index, p as depends_on,
  coalesce(d, false) as dependent, coalesce(k, false) as cached
from (select seq, case when aggregate_type = '' then 'Track' when seq % 3 = 0 then lower(aggregate_type)
        when user_id % 5 = 0 then 'address' else aggregate_type end as type from cdc_event) t
left join (values ('INVOICE', 0, 0, 'Customer', false, true), ('INVOICELINE', 0, 1, 'Invoice', true, false),
  ('CUSTOMER', 1, 0, 'Address', false, true), ('ADDRESS', 2, 0, null, false, true)) r(name, g, e, p, d, k) on r.name = upper(t.type)""")


def live_events(spark: SparkSession, folder: str) -> DataFrame:
    """Changes with their inner payload, as the gate and the sort take them."""
    events = tpch.cdc_event(spark, folder).where("snapshot is null and op <> 'r'")
    kind = F.col("aggregate_type")
    payload = F.when(kind == "INVOICELINE", tpch.inner_payload("INVOICELINE")).when(
        kind == "INVOICE", tpch.inner_payload("INVOICE")).otherwise(tpch.inner_payload("CUSTOMER"))
    return events.select(
        "seq", "created_ts", kind.alias("entity"), "event_type", F.col("aggregate_id").cast("string").alias("aggregate_id"),
        payload.alias("payload"))


def _known(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Rich customers and finished orders exist on the target side."""
    return {
        spec.CUSTOMER: tpch.table(spark, folder, "customer").where("c_acctbal > 5000").select(
            F.col("c_custkey").cast("string").alias("dep_id")),
        spec.INVOICE: tpch.table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
            F.col("o_orderkey").cast("string").alias("dep_id")),
    }


def dependency_gate(spark: SparkSession, folder: str) -> DataFrame:
    """All changes as one batch."""
    configure(spark)
    return gate(live_events(spark, folder), _known(spark, folder)).select("seq", "satisfied_by")


_GATED = {
    "ready_invoice": """select i.*, case when user_id in (select aggregate_id from live where aggregate_type = 'CUSTOMER') then 'in_batch'
        when user_id in (select c_custkey from customer where c_acctbal > 5000) then 'known' end as via
        from live i where aggregate_type = 'INVOICE'""",
}
ORACLES["dependency_gate"] = query("""
select seq, case when event_type = 'CREATED' then 'known' else 'skipped' end as satisfied_by from live where aggregate_type = 'CUSTOMER'
union all select seq, via from ready_invoice
union all select seq, case when aggregate_id in (select aggregate_id from ready_invoice where via is not null) then 'in_batch'
  when aggregate_id in (select o_orderkey from orders where o_orderstatus = 'F') then 'known' end
from live where aggregate_type = 'INVOICELINE'""", **_GATED)

_CUTS = ("2024-01-16 00:00:00", "2024-01-31 00:00:00")


def replay(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches, split in mid-January; what the first holds is offered again with the second."""
    configure(spark)
    events = live_events(spark, folder)
    middle, end = (F.lit(t).cast("timestamp") for t in _CUTS)
    known = _known(spark, folder)
    first = cut(hold_and_release(events.where(F.col("created_ts") < middle), None, known, middle, 10 * 86400))
    held = first.where("decision = 'hold'").select(*events.columns, "held_since")
    released = first.where("decision = 'release'")
    for parent in known:
        done = released.where(F.col("entity") == parent).select(F.col("aggregate_id").alias("dep_id")).distinct()
        known[parent] = known[parent].unionByName(done)
    second = hold_and_release(events.where(F.col("created_ts") >= middle), held, known, end, 10 * 86400)
    columns = ["seq", "decision", "satisfied_by", F.unix_millis("held_since").alias("held_since")]
    return first.select(F.lit(1).alias("batch"), *columns).unionByName(second.select(F.lit(2).alias("batch"), *columns))


def _batch_sql(batch: int, events: str, customers: str, invoices: str) -> dict[str, str]:
    return {
        f"e{batch}": events,
        f"i{batch}": f"""select seq, aggregate_id, held, case
            when user_id in (select aggregate_id from e{batch} where aggregate_type = 'CUSTOMER') then 'in_batch'
            when user_id in ({customers}) then 'known' end as via from e{batch} where aggregate_type = 'INVOICE'""",
        f"v{batch}": f"""select seq, held, aggregate_type, aggregate_id, case when event_type = 'CREATED' then 'known' else 'skipped' end as via
              from e{batch} where aggregate_type = 'CUSTOMER'
            union all select seq, held, 'INVOICE', aggregate_id, via from i{batch}
            union all select seq, held, aggregate_type, aggregate_id,
              case when aggregate_id in (select aggregate_id from i{batch} where via is not null) then 'in_batch'
                   when aggregate_id in ({invoices}) then 'known' end from e{batch} where aggregate_type = 'INVOICELINE'""",
    }


ORACLES["hold_and_release"] = query(f"""
select 1 as batch, seq, case when via is null then 'hold' else 'release' end as decision, via as satisfied_by,
  case when via is null then epoch_ms(timestamp '{_CUTS[0]}') end as held_since from v1
union all select 2, seq, case when via is not null then 'release' when held then 'dead:dependency_timeout' else 'hold' end, via,
  case when via is null then epoch_ms(case when held then timestamp '{_CUTS[0]}' else timestamp '{_CUTS[1]}' end) end from v2""",
    **_batch_sql(
        1, f"select *, false as held from live where created_ts < timestamp '{_CUTS[0]}'",
        "select c_custkey from customer where c_acctbal > 5000", "select o_orderkey from orders where o_orderstatus = 'F'"),
    **_batch_sql(
        2, f"""select *, false as held from live where created_ts >= timestamp '{_CUTS[0]}'
            union all select *, true from live where seq in (select seq from v1 where via is null)""",
        """select c_custkey from customer where c_acctbal > 5000
           union all select aggregate_id from v1 where aggregate_type = 'CUSTOMER' and via is not null""",
        """select o_orderkey from orders where o_orderstatus = 'F'
           union all select aggregate_id from v1 where aggregate_type = 'INVOICE' and via is not null"""),
)


def topological_order(spark: SparkSession, folder: str) -> DataFrame:
    """All events as one batch; lines name their invoice in another case, which only the lenient lookup sees."""
    configure(spark)
    ordered = dependency_order(live_events(spark, folder), ignore_case=True)
    return ordered.select(
        "seq", F.col("place.level").alias("level"), F.array_join("place.path", "/").alias("path"), "parents")


ORACLES["topological_order"] = query("""
select seq, 0 as level, cast(seq as varchar) as path, 0 as parents from live where aggregate_type = 'CUSTOMER'
union all select seq, level, path, level from placed
union all select l.seq, coalesce(p.level + 1, 0), coalesce(p.path || '/', '') || cast(l.seq as varchar), case when p.seq is null then 0 else 1 end
from live l left join (select * from (select *, row_number() over (partition by aggregate_id order by seq) as n from placed) x where n = 1) p
  on p.aggregate_id = l.aggregate_id
where l.aggregate_type = 'INVOICELINE'""",
    placed="""select i.seq, i.aggregate_id, case when c.first is null then 0 else 1 end as level,
        coalesce(cast(c.first as varchar) || '/', '') || cast(i.seq as varchar) as path
        from live i left join (select aggregate_id, min(seq) as first from live where aggregate_type = 'CUSTOMER' group by aggregate_id) c
          on c.aggregate_id = i.user_id where i.aggregate_type = 'INVOICE'""")

# Streams --------------------------------------------------------------------------------------


#: Every event is on one of the two streams.
_OLD_SIDE = "coalesce(event_type in ('signup', 'view'), false)"


def _both(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    events = tpch.table(spark, folder, "events")
    sides = [
        events.where(condition).select(
            F.col("props").alias("value"), (F.col("event_id") * 2 + i).alias("seq"), F.lit(source).alias("stream"),
            F.col("user_id").alias("aggregate_id"), F.md5(F.col("event_id").cast("string")).alias("unique_identifier"))
        for i, (source, condition) in enumerate([
            (spec.OLD_TO_NEW, f"{_OLD_SIDE}"), (spec.NEW_TO_OLD, f"not {_OLD_SIDE}")])
    ]
    return streams.merged(*sides)


def merge_two_streams(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder).select("value", "seq", "stream")


def keyed_queue(spark: SparkSession, folder: str) -> DataFrame:
    return streams.keyed_queue(_both(spark, folder))


def event_store_append(spark: SparkSession, folder: str) -> DataFrame:
    return streams.event_store_rows(_both(spark, folder))


_BOTH = {"both_streams": f"""
    select props as value, event_id * 2 as seq, 'old_to_new' as stream, user_id, event_id from events where {_OLD_SIDE}
    union all select props, event_id * 2 + 1, 'new_to_old', user_id, event_id from events where not {_OLD_SIDE}"""}
ORACLES["merge_two_streams"] = query("select value, seq, stream from both_streams", **_BOTH)
ORACLES["keyed_queue"] = query("select cast(user_id as varchar) as key, value from both_streams", **_BOTH)
ORACLES["event_store_append"] = query("""
select md5('document|' || stream || '|' || md5(cast(event_id as varchar)) || '|' || cast(seq as varchar)) as "Id", stream as "Source",
  md5('sync|' || md5(cast(event_id as varchar))) as "SyncId", value as "Data" from both_streams""", **_BOTH)


def batch_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One batch per day."""
    configure(spark)
    return batch_summary(live_events(spark, folder), F.date_format("created_ts", "yyyy-MM-dd"), per_row=100)


ORACLES["batch_summary"] = query("""
select strftime(created_ts, '%Y-%m-%d') as batch, seq // 100 as part, count(*) as events,
  string_agg(cast(aggregate_id as varchar) || ':' || aggregate_type, ', ' order by seq) as summary
from live group by 1, 2""")

QUERIES = {
    "envelope_decode": envelope_decode,
    "payload_typed_decode": payload_typed_decode,
    "decimal_base64": decimal_base64,
    "filter_pipeline_events": filter_pipeline_events,
    "snapshot_progress": snapshot_progress,
    "echo_suppression": echo_suppression,
    "route_events": route_events,
    "noop_suppression": noop_suppression,
    "priority_lookup": priority_lookup,
    "dependency_gate": dependency_gate,
    "hold_and_release": replay,
    "topological_order": topological_order,
    "merge_two_streams": merge_two_streams,
    "keyed_queue": keyed_queue,
    "event_store_append": event_store_append,
    "batch_summary": batch_lines,
}
