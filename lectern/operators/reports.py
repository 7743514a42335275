"""The store of revision reports: kept by their ids, read by the rows they speak of, and refused once it is retired."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.operators import writes
from lectern.sources.store import Store

TABLE, _RETIRED = "reports", "reports retired"


class Retired(RuntimeError):
    """The reports have no store any more."""


def insert(store: Store, reports: DataFrame) -> int:
    """Keep reports (report_id and what else they have); one that is kept already is replaced. The new version."""
    txn = store.begin()
    if txn.ledger.get(_RETIRED):
        raise Retired(TABLE)
    if TABLE in txn.lists:
        txn.merge(TABLE, reports, lambda old, new: writes.merge(old, new, "report_id", {}))
    else:
        txn.put(TABLE, reports, "report_id")
    return txn.publish()


def fetch(store: Store, entity: str, ids: DataFrame) -> DataFrame | None:
    """The reports on rows (id) of an entity; None if no rows are asked for, even of a retired store."""
    if ids.isEmpty():
        return None
    state = store.state()
    if state["ledger"].get(_RETIRED):
        raise Retired(TABLE)
    found = store.read(TABLE)
    return found.filter(found["entity"] == entity).join(ids.select(ids["id"].alias("entity_id")).distinct(), "entity_id", "left_semi")


def retire(store: Store) -> int:
    """Drop the reports: the table goes, and inserts and fetches are refused from then on."""
    txn = store.begin()
    if TABLE in txn.lists:
        txn.remove(TABLE)
    return txn.publish(**{_RETIRED: True})
