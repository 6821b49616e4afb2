"""Application of a batch of decoded row events to the other side, one module per entity.

Every function takes the state and the typed events of one entity and direction
(``seq, unique_identifier, op`` and the payload's fields) and returns the changes.
"""

from twinsync import spec
from twinsync.operators.apply.address import address_to_new, address_to_old
from twinsync.operators.apply.customer import customer_to_new, customer_to_old, deletions, remove_customers
from twinsync.operators.apply.invoice import invoice_to_new, invoice_to_old, without_late_owners
from twinsync.operators.apply.line import line_to_new, line_to_old

# Parents first: a batch applies the entities of one direction in this order.
APPLY = {
    (spec.OLD_TO_NEW, spec.CUSTOMER): customer_to_new,
    (spec.OLD_TO_NEW, spec.INVOICE): invoice_to_new,
    (spec.OLD_TO_NEW, spec.LINE): line_to_new,
    (spec.NEW_TO_OLD, spec.ADDRESS): address_to_old,
    (spec.NEW_TO_OLD, spec.CUSTOMER): customer_to_old,
    (spec.NEW_TO_OLD, spec.INVOICE): invoice_to_old,
    (spec.NEW_TO_OLD, spec.LINE): line_to_old,
}

__all__ = [
    "APPLY", "address_to_new", "address_to_old", "customer_to_new", "customer_to_old", "deletions",
    "invoice_to_new", "invoice_to_old", "line_to_new", "line_to_old", "remove_customers",
    "without_late_owners",
]
