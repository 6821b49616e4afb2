"""What is being kept in step: tables, keys, dependencies, routes and payload fields.

Everything here is small, constant configuration.  A user with another pair of
schemas edits this module and the entity modules in ``operators``.
"""

from __future__ import annotations

from dataclasses import dataclass

OLD, NEW = "old", "new"
OLD_TO_NEW, NEW_TO_OLD = "old_to_new", "new_to_old"

# Entities ------------------------------------------------------------------

ADDRESS, CUSTOMER, INVOICE, LINE = "ADDRESS", "CUSTOMER", "INVOICE", "INVOICELINE"

# Column holding the row key of every table.
TABLE_KEYS = {
    "old_customer": "CustomerId",
    "old_invoice": "InvoiceId",
    "old_invoice_line": "InvoiceLineId",
    "new_address": "AddressId",
    "new_customer": "CustomerId",
    "new_invoice": "InvoiceId",
    "new_invoice_line": "InvoiceLineId",
    "map_address": "AddressKey",
    "map_customer": "NewId",
    "map_invoice": "NewId",
    "map_invoice_line": "NewId",
    "processed_old": "unique_identifier",
    "processed_new": "unique_identifier",
    "migration_ledger": "MigrationName",
    "key_counters": "TableName",
    "row_versions": "RowName",
    "sync_progress": "Milestone",
}

OLD_ADDRESS = ["Address", "City", "State", "Country", "PostalCode"]
BILLING_ADDRESS = ["BillingAddress", "BillingCity", "BillingState", "BillingCountry", "BillingPostalCode"]
NEW_ADDRESS = ["Street", "City", "State", "Country", "PostalCode"]

_MAPPING = "OldId bigint, NewId string, MappingTimestamp timestamp"
TABLE_SCHEMAS = {
    "old_customer": "CustomerId bigint, FirstName string, LastName string, Address string, City string, "
    "State string, Country string, PostalCode string, Phone string, Email string",
    "old_invoice": "InvoiceId bigint, CustomerId bigint, InvoiceDate timestamp, BillingAddress string, "
    "BillingCity string, BillingState string, BillingCountry string, BillingPostalCode string, "
    "Total decimal(18,2)",
    "old_invoice_line": "InvoiceLineId bigint, InvoiceId bigint, TrackId bigint, UnitPrice decimal(18,6), "
    "Quantity int",
    "new_address": "AddressId string, Street string, City string, State string, Country string, "
    "PostalCode string",
    "new_customer": "CustomerId string, FirstName string, LastName string, AddressId string, Phone string, "
    "Email string",
    "new_invoice": "InvoiceId string, CustomerId string, InvoiceDate timestamp, BillingAddressId string, "
    "Total decimal(18,2), TestValue3 decimal(18,3)",
    "new_invoice_line": "InvoiceLineId string, InvoiceId string, TrackId bigint, UnitPrice decimal(18,6), "
    "Quantity int",
    "map_address": "AddressKey string, Street string, City string, State string, Country string, "
    "PostalCode string, AddressId string, MappingTimestamp timestamp",
    "map_customer": _MAPPING,
    "map_invoice": _MAPPING,
    "map_invoice_line": _MAPPING,
    "processed_old": "unique_identifier string",
    "processed_new": "unique_identifier string",
    "migration_ledger": "MigrationName string, AppliedOn timestamp",
    "key_counters": "TableName string, LastKey bigint",
    "row_versions": "RowName string, EventTime timestamp, LastSeq bigint",
    "sync_progress": "Milestone string, DoneAt timestamp",
}

# Dependencies ----------------------------------------------------------------


@dataclass(frozen=True)
class Dependency:
    """One element of a priority group: an entity type and the id field that names it."""

    type: str
    id_field: str


# Priority groups, parents first.
PRIORITY_GROUPS = [
    [Dependency("Invoice", "InvoiceId"), Dependency("InvoiceLine", "InvoiceId")],
    [Dependency("Customer", "CustomerId"), Dependency("Invoice", "CustomerId")],
    [Dependency("Address", "AddressId"), Dependency("Customer", "AddressId")],
]

# Marker ids and the priority of a type that is in no group.
CREATE_NEW_ADDRESS = "CREATE_NEW_ADDRESS"
MISSING_AGGREGATE_ID = "MISSING_AGGREGATE_ID"
MISSING_EVENT_TYPE = "MISSING_EVENT_TYPE"
NO_PRIORITY = 2147483647
ZERO_KEY = "00000000000000000000000000000000"

# Seconds an event may wait for its parent, and batch interval.
DEPENDENCY_TIMEOUT_SECONDS = 120
BATCH_INTERVAL = "500 milliseconds"

# Routes ------------------------------------------------------------------------

# Outbox table of every entity, by direction.
OUTBOX = {
    OLD_TO_NEW: {CUSTOMER: "customer_outbox", INVOICE: "invoice_outbox", LINE: "invoiceline_outbox"},
    NEW_TO_OLD: {
        CUSTOMER: "CustomerOutbox",
        INVOICE: "InvoiceOutbox",
        LINE: "InvoiceLineOutbox",
        ADDRESS: "AddressOutbox",
    },
}
# Address deletions have no route; every other entity is routed for c, u and d.
UNROUTED = {(NEW_TO_OLD, ADDRESS, "d")}


def routes() -> dict[str, tuple[str, str, str]]:
    """Route key ``source_table_op`` to (source, entity, op)."""
    return {
        f"{source}_{table}_{op}": (source, entity, op)
        for source, tables in OUTBOX.items()
        for entity, table in tables.items()
        for op in "cud"
        if (source, entity, op) not in UNROUTED
    }


# Payload fields -------------------------------------------------------------------

# (field, kind); kinds: key, text, int (64 bits), int32, decimal(n), time(precision).
PAYLOADS = {
    (OLD, CUSTOMER): [
        ("CustomerId", "int"), ("FirstName", "text"), ("LastName", "text"), ("Address", "text"),
        ("City", "text"), ("State", "text"), ("Country", "text"), ("PostalCode", "text"),
        ("Phone", "text"), ("Email", "text"),
    ],
    (OLD, INVOICE): [
        ("InvoiceId", "int"), ("CustomerId", "int"), ("InvoiceDate", "time(3)"),
        ("BillingAddress", "text"), ("BillingCity", "text"), ("BillingState", "text"),
        ("BillingCountry", "text"), ("BillingPostalCode", "text"), ("Total", "decimal(2)"),
        ("TestValue3", "decimal(3)"),
    ],
    (OLD, LINE): [
        ("InvoiceLineId", "int"), ("InvoiceId", "int"), ("TrackId", "int"),
        ("UnitPrice", "decimal(6)"), ("Quantity", "int32"),
    ],
    (NEW, ADDRESS): [
        ("AddressId", "text"), ("Street", "text"), ("City", "text"), ("State", "text"),
        ("Country", "text"), ("PostalCode", "text"),
    ],
    (NEW, CUSTOMER): [
        ("CustomerId", "text"), ("FirstName", "text"), ("LastName", "text"), ("AddressId", "text"),
        ("Phone", "text"), ("Email", "text"),
    ],
    (NEW, INVOICE): [
        ("InvoiceId", "text"), ("CustomerId", "text"), ("InvoiceDate", "time(6)"),
        ("BillingAddressId", "text"), ("Total", "decimal(2)"), ("TestValue3", "decimal(3)"),
    ],
    (NEW, LINE): [
        ("InvoiceLineId", "text"), ("InvoiceId", "text"), ("TrackId", "int"),
        ("UnitPrice", "decimal(6)"), ("Quantity", "int32"),
    ],
}

ROW_KEY = {ADDRESS: "AddressId", CUSTOMER: "CustomerId", INVOICE: "InvoiceId", LINE: "InvoiceLineId"}
