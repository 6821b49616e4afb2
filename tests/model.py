"""Event-by-event model of the apply operators, for tests only.

Tables are dicts by key.  ``run`` applies events one at a time and returns the fate of
each; the order is the one the operators document.
"""

from __future__ import annotations

import hashlib

OLD_ADDRESS = ["Address", "City", "State", "Country", "PostalCode"]
BILLING = ["BillingAddress", "BillingCity", "BillingState", "BillingCountry", "BillingPostalCode"]
NEW_ADDRESS = ["Street", "City", "State", "Country", "PostalCode"]


def md5(*parts) -> str:
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


def exact_key(parts) -> str:
    return "|".join("-" if p is None else f"{len(p)}:{p}" for p in parts)


class Model:
    def __init__(self):
        self.old_customer, self.old_invoice, self.old_line = {}, {}, {}
        self.new_address, self.new_customer, self.new_invoice, self.new_line = {}, {}, {}, {}
        self.map_customer, self.map_invoice, self.map_line = {}, {}, {}  # old id -> new id
        self.map_address = {}  # exact key -> address id
        self.fates = {}

    def new_id(self, entity, old):
        table = {"customer": self.map_customer, "invoice": self.map_invoice, "invoiceline": self.map_line}[entity]
        return table.get(old)

    # Addresses ---------------------------------------------------------------

    def find_address(self, key):
        found = [i for i, parts in self.new_address.items() if exact_key(parts) == key]
        return min(found) if found else None

    def make_address(self, parts, event):
        made = md5("address", exact_key(parts), event["unique_identifier"])
        self.new_address[made] = tuple(parts)
        return made

    # Old to new, one event -------------------------------------------------------

    def line(self, e):
        key, op = e["InvoiceLineId"], e["op"]
        new = self.map_line.get(key)
        if op == "c":
            if new:
                return "skip:already_mapped"
            parent = self.map_invoice.get(e["InvoiceId"])
            if parent not in self.new_invoice:
                return "dead:parent_missing"
            self.map_line[key] = new = md5("invoiceline", key)
            self.new_line[new] = (parent, e["TrackId"], e["Quantity"])
            return "applied"
        if new is None:
            return "dead:mapping_missing" if op == "u" else "skip:not_mapped"
        if new not in self.new_line:
            return "dead:row_missing" if op == "u" else "skip:row_missing"
        if op == "u":
            self.new_line[new] = (self.new_line[new][0], e["TrackId"], e["Quantity"])
        else:
            del self.new_line[new]
        return "applied"

    def invoice(self, e):
        key, op = e["InvoiceId"], e["op"]
        new = self.map_invoice.get(key)
        if op == "c" and new:
            return "skip:already_mapped"
        if op != "c" and new is None:
            return "dead:mapping_missing" if op == "u" else "skip:not_mapped"
        if op != "c" and new not in self.new_invoice:
            return "skip:row_missing"
        if op == "d":
            del self.new_invoice[new]
            self.new_line = {k: v for k, v in self.new_line.items() if v[0] != new}
            return "applied"
        parts = [e[c] for c in BILLING]
        if not any(parts):
            return "dead:address_empty"
        owner = self.map_customer.get(e["CustomerId"])
        if owner not in self.new_customer:
            return "dead:parent_missing"
        address = self.map_address.get(exact_key(parts))
        if address is None:
            address = self.find_address(exact_key(parts)) or self.make_address(parts, e)
            self.map_address[exact_key(parts)] = address
        if op == "c":
            self.map_invoice[key] = new = md5("invoice", key)
        self.new_invoice[new] = (owner, address, e["Total"])
        return "applied"

    # Old to new, customers in order of arrival -------------------------------------------

    def customers(self, events):
        for e in sorted(events, key=lambda e: e["seq"]):
            self.fates[e["seq"]] = self.customer(e)

    def customer(self, e):
        key, op, parts = e["CustomerId"], e["op"], tuple(e[c] for c in OLD_ADDRESS)
        new = self.map_customer.get(key)
        if op == "c":
            if new:
                return "skip:already_mapped"
            self.map_customer[key] = new = md5("customer", key)
            self.new_customer[new] = (e["FirstName"], self.find_or_claim(parts, e))
            return "applied"
        if new is None:
            return "dead:mapping_missing" if op == "u" else "skip:not_mapped"
        if new not in self.new_customer:
            return "skip:row_missing"
        if op == "u":
            address = self.new_customer[new][1]
            if address in self.new_address:
                self.new_address[address] = parts
                self.claim(address, exact_key(parts), False)
            else:
                address = self.find_or_claim(parts, e)
            self.new_customer[new] = (e["FirstName"], address)
            return "applied"
        del self.new_customer[new]
        dead = {i for i, v in self.new_invoice.items() if v[0] == new}
        self.new_invoice = {i: v for i, v in self.new_invoice.items() if i not in dead}
        self.new_line = {i: v for i, v in self.new_line.items() if v[0] not in dead}
        return "applied"

    def find_or_claim(self, parts, e):
        address = self.find_address(exact_key(parts))
        if address is None:
            address = self.make_address(parts, e)
            self.claim(address, exact_key(parts), True)
        return address

    def claim(self, address, key, fresh):
        """The mapping follows its address unless another one holds the key; an address without one stays without."""
        own = [k for k, a in self.map_address.items() if a == address]
        if not (own or fresh) or self.map_address.get(key, address) != address or (own and min(own) == key):
            return
        for k in own:
            del self.map_address[k]
        self.map_address[key] = address
