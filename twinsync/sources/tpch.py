"""The old schema, its change stream and a started-up state, derived from TPC-H-shaped tables.

These are the inputs of the registered queries; each function reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync.functions.keys import number_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utc(column: str) -> Column:
    return F.col(column).cast("timestamp")


def old_customer(spark: SparkSession, folder: str, extra: list[str] | None = None) -> DataFrame:
    street = F.concat(F.lower("c_mktsegment"), F.lit(" street"))
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("CustomerId"),
            F.col("c_name").alias("FirstName"),
            F.col("c_mktsegment").alias("LastName"),
            F.when(key % 7 == 0, F.upper(street)).otherwise(street).alias("Address"),
            F.col("n_name").alias("City"),
            F.when(key % 3 != 0, F.col("r_name")).alias("State"),
            F.col("r_name").alias("Country"),
            F.when(key % 5 != 0, F.lpad(F.col("c_nationkey").cast("string"), 5, "0")).alias("PostalCode"),
            F.lit(None).cast("string").alias("Phone"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("Email"),
            *(extra or []),
        )
    )


def old_invoice(spark: SparkSession, folder: str, extra: list[str] | None = None) -> DataFrame:
    customer = old_customer(spark, folder)
    return (
        table(spark, folder, "orders")
        .join(customer, F.col("o_custkey") == F.col("CustomerId"))
        .select(
            F.col("o_orderkey").alias("InvoiceId"),
            F.col("o_custkey").alias("CustomerId"),
            utc("o_orderdate").alias("InvoiceDate"),
            F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.col("Address"), F.lit(" annex")))
            .otherwise(F.col("Address")).alias("BillingAddress"),
            F.col("City").alias("BillingCity"),
            F.col("State").alias("BillingState"),
            F.col("Country").alias("BillingCountry"),
            F.col("PostalCode").alias("BillingPostalCode"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("Total"),
            *(extra or []),
        )
    )


def _line_content() -> Column:
    money = [F.col(c).cast("decimal(18,2)").cast("string")
             for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    tail = [F.col("l_returnflag"), F.col("l_linestatus"), F.unix_seconds(utc("l_shipdate")).cast("string")]
    return F.concat_ws("|", *keys, *money, *tail)


def old_invoice_line(spark: SparkSession, folder: str, extra: list[str] | None = None) -> DataFrame:
    """Lines with a dense unique key; ``(l_orderkey, l_linenumber)`` is not unique in the data."""
    lines = table(spark, folder, "lineitem").withColumn("_content", _line_content())
    return number_rows(lines, F.col("_content"), "InvoiceLineId").select(
        "InvoiceLineId",
        F.col("l_orderkey").alias("InvoiceId"),
        F.col("l_partkey").alias("TrackId"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("UnitPrice"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        *(extra or []),
    )


def line_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """``InvoiceId`` of all lines, which needs no numbers."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("InvoiceId"))


def cdc_event(spark: SparkSession, folder: str) -> DataFrame:
    """Change events of all three entities with arrival order ``seq``."""
    events = table(spark, folder, "events").withColumn(
        "json_k", F.regexp_replace("props", "[^0-9]", "").cast("bigint")
    )
    seq, kind = F.col("event_id"), F.col("event_type")
    is_error, turn = kind == "error", F.col("event_id") % 4
    return events.select(
        seq.alias("seq"),
        utc("ts").alias("created_ts"),
        F.when(kind.isin("signup", "view"), "CUSTOMER").when(kind == "purchase", "INVOICE")
        .when(kind == "click", "INVOICELINE").when(turn < 2, "").otherwise("CUSTOMER").alias("aggregate_type"),
        F.when(kind == "view", "UPDATED").otherwise("CREATED").alias("event_type"),
        F.when(kind == "purchase", seq).when(kind == "click", seq + F.col("json_k") % 5 - 2)
        .otherwise(F.col("user_id")).alias("aggregate_id"),
        "user_id",
        F.when(is_error & (turn == 0), "true").when(is_error & (turn == 1), "last").alias("snapshot"),
        F.when(is_error & (turn == 2), "r").when(kind == "view", "u").otherwise("c").alias("op"),
        F.when(is_error & (turn == 3), F.md5((seq - 1).cast("string")))
        .otherwise(F.md5(seq.cast("string"))).alias("unique_identifier"),
    )


# Outbox table of every entity type in the derived stream.
_TABLES = {"CUSTOMER": "customer_outbox", "INVOICE": "invoice_outbox", "INVOICELINE": "invoiceline_outbox"}


def inner_payload(kind: str) -> Column:
    """The ids an event of each type carries in its payload."""
    quote = F.lit('"')
    if kind == "INVOICELINE":
        fields = F.concat(F.lit('{"InvoiceLineId":'), F.col("seq"), F.lit(',"invoiceid":'), F.col("aggregate_id"))
    elif kind == "INVOICE":
        fields = F.concat(
            F.lit('{"InvoiceId":'), F.col("aggregate_id"), F.lit(',"CustomerId":'), quote, F.col("user_id"), quote
        )
    else:
        fields = F.concat(F.lit('{"CustomerId":'), F.col("aggregate_id"), F.lit(',"FirstName":"user"'))
    return F.concat(fields, F.lit("}"))


def cdc_json(spark: SparkSession, folder: str) -> DataFrame:
    """The same events as JSON texts: ``seq`` and ``value``.

    The payload is an object on even and an escaped text on odd ``seq``; some events
    have no ``created_at``, no ``__op``, an unknown operation or source, or are no JSON.
    """
    e = cdc_event(spark, folder)
    kind = F.col("aggregate_type")
    inner = (
        F.when(kind == "INVOICELINE", inner_payload("INVOICELINE"))
        .when(kind == "INVOICE", inner_payload("INVOICE"))
        .otherwise(inner_payload("CUSTOMER"))
    )
    escaped = F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"'))
    payload = F.when(F.col("seq") % 2 == 0, inner).otherwise(escaped)
    outbox = F.when(kind == "INVOICELINE", "invoiceline_outbox").when(kind == "INVOICE", "invoice_outbox")
    millis = F.unix_millis("created_ts").cast("string")
    snapshot = F.concat(
        F.lit('{"source":{"snapshot":"'), F.col("snapshot"), F.lit('","ts_ms":'), millis,
        F.lit('},"created_at":'), millis, F.lit("}"),
    )
    change = F.concat(
        F.lit('{"event_id":'), F.col("seq"),
        F.lit(',"aggregate_id":" '), F.col("aggregate_id"),
        F.lit('","aggregate_type":"'), F.when(F.col("seq") % 13 == 0, F.lower(kind)).otherwise(kind),
        F.lit('","event_type":"'),
        F.when(F.col("seq") % 97 == 0, "").when(F.col("seq") % 101 == 0, "TRUNCATED").otherwise(F.col("event_type")),
        F.lit('","payload":'), payload,
        F.lit(',"unique_identifier":"'), F.col("unique_identifier"),
        F.lit('","created_at":'),
        F.when(F.col("seq") % 17 == 0, F.concat(F.lit('"'), F.date_format("created_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                                                F.lit('"')))
        .when(F.col("seq") % 103 == 0, "null").otherwise(millis),
        F.when(F.col("seq") % 89 == 0, "").otherwise(F.concat(F.lit(',"__op":"'), F.col("op"), F.lit('"'))),
        F.lit(',"__source_table":"'), F.coalesce(outbox, F.lit("customer_outbox")),
        F.when(F.col("seq") % 107 == 0, '"').otherwise(
            F.concat(F.lit('","__source_name":"'),
                     F.when(F.col("seq") % 109 == 0, "elsewhere").otherwise("old_to_new"), F.lit('"'))),
        F.lit("}"),
    )
    value = (
        F.when(F.col("snapshot").isNotNull(), snapshot)
        .when(F.col("seq") % 113 == 0, F.concat(F.lit("not a valid json "), F.col("seq")))
        .otherwise(change)
    )
    return e.select("seq", "created_ts", "user_id", value.alias("value"))
