"""Bulk migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync.checks import common
from twinsync.checks.sql import address_key, query
from twinsync.operators.state import State
from twinsync.plans import migration
from twinsync.sources import tpch
from twinsync.spec import NEW_ADDRESS


def _after_addresses(spark: SparkSession, folder: str) -> State:
    state = common.old_state(spark, folder)
    return state.replace(**migration.migrate_addresses(state, common.now()))


def _with_old_id(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return rows.join(mapping.select("OldId", F.col("NewId").alias(key)), key)


def migrate_addresses(spark: SparkSession, folder: str) -> DataFrame:
    made = migration.migrate_addresses(common.old_state(spark, folder), common.now())
    return made["new_address"].join(made["map_address"].select("AddressId", "AddressKey"), "AddressId")


def migrate_customers(spark: SparkSession, folder: str) -> DataFrame:
    made = migration.migrate_customers(_after_addresses(spark, folder), common.now())
    return _with_old_id(made["new_customer"], made["map_customer"], "CustomerId")


def migrate_invoices(spark: SparkSession, folder: str) -> DataFrame:
    state = _after_addresses(spark, folder)
    state = state.replace(**migration.migrate_customers(state, common.now()))
    made = migration.migrate_invoices(state, common.now())
    rows = _with_old_id(made["new_invoice"], made["map_invoice"], "InvoiceId")
    return rows.withColumn("InvoiceDate", F.unix_millis("InvoiceDate"))


def migrate_invoice_lines(spark: SparkSession, folder: str) -> DataFrame:
    state = common.old_state(spark, folder)
    invoices = migration.id_mapping(state["old_invoice"], "invoice", "InvoiceId", common.now())
    return migration.migrate_lines(state.replace(map_invoice=invoices), common.now())["new_invoice_line"]


def migration_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices whose customer, and invoices whose address, was not migrated (only rich customers were)."""
    state = common.old_state(spark, folder)
    rich = tpch.old_customer(spark, folder, ["c_acctbal"]).where("c_acctbal > 5000").drop("c_acctbal")
    part = state.replace(old_customer=rich)
    part = part.replace(**migration.migrate_addresses(part.replace(old_invoice=state["old_invoice"].where(F.lit(False))), common.now()))
    part = part.replace(**migration.migrate_customers(part, common.now()))
    rows = migration.migrate_invoices(part, common.now())["new_invoice"]
    return rows.select(
        "InvoiceId", F.col("CustomerId").isNull().alias("no_customer"),
        (F.col("BillingAddressId") == "0" * 32).alias("no_address"),
    ).where("no_customer or no_address")


def migration_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One migration per nation; the ledger lists those of nations whose customers all have orders."""
    common.configure(spark)
    name = F.concat(F.lit("migrate_"), F.col("n_name"))
    nations = tpch.table(spark, folder, "nation")
    customers = tpch.table(spark, folder, "customer").where("c_acctbal < 0 or c_mktsegment = 'BUILDING'")
    done = (
        nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(tpch.table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"))
        .where("o_totalprice > 490000")
        .groupBy(name.alias("MigrationName")).agg(F.max(tpch.utc("o_orderdate")).alias("AppliedOn"))
    )
    wanted = nations.select(name.alias("MigrationName"), F.col("n_nationkey").alias("position"))
    return migration.pending(done, wanted)


QUERIES = {
    "migrate_addresses": migrate_addresses,
    "migrate_customers": migrate_customers,
    "migrate_invoices": migrate_invoices,
    "migrate_invoice_lines": migrate_invoice_lines,
    "migration_misses": migration_misses,
    "migration_ledger": migration_ledger,
}

ORACLES = {
    "migrate_addresses": query(
        f"select AddressId, {', '.join(NEW_ADDRESS)}, {address_key(NEW_ADDRESS, 'exact')} as AddressKey from all_address"),
    "migrate_customers": query("select * from full_new_customer"),
    "migrate_invoices": query("""select OldId, InvoiceId, CustomerId, epoch_ms(InvoiceDate) as InvoiceDate, BillingAddressId,
        Total, TestValue3 from full_new_invoice"""),
    "migrate_invoice_lines": query("select InvoiceLineId, InvoiceId, TrackId, UnitPrice, Quantity from full_new_line"),
    "migration_misses": query(f"""
        select InvoiceId, no_customer, no_address from (
          select md5('invoice|' || cast(InvoiceId as varchar)) as InvoiceId,
                 CustomerId not in (select CustomerId from rich) as no_customer,
                 {address_key(['BillingAddress', 'BillingCity', 'BillingState', 'BillingCountry', 'BillingPostalCode'], 'ignore_case')}
                   not in (select {address_key(['Address', 'City', 'State', 'Country', 'PostalCode'], 'ignore_case')} from rich) as no_address
          from all_invoice) x
        where no_customer or no_address""",
        rich="select * from all_customer where c_acctbal > 5000"),
    "migration_ledger": """
        select 'migrate_' || n_name as "MigrationName", n_nationkey as position from nation
        where n_nationkey not in (select c_nationkey from customer join orders on c_custkey = o_custkey
          where (c_acctbal < 0 or c_mktsegment = 'BUILDING') and o_totalprice > 490000)""",
}
