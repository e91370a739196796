"""A document table kept up to date by insert requests and deletes, and searched.

The table is a :class:`logloom.tables.DocumentTable`: an insert adds files, a delete writes again only
files that hold what it removes, and what fails half way changes nothing and can run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.documents import expand_payloads
from logloom.tables import DocumentTable


def update(spark: SparkSession, root: str, requests: DataFrame | None = None, order_by: Column | None = None, deletes: dict[str, str] | None = None, txn: tuple[str, int] | None = None) -> dict[str, int]:
    """Inserts the documents of ``requests`` (column ``payload``) with new ids, then deletes what ``deletes`` finds
    in each database; ``inserted``, ``deleted`` and the table's ``version``.

    ``order_by`` is computed from ``fields`` and says in which order ids are given. With ``txn``, an application and a number that
    grows, a job that runs again after a failure does not do again what it had done.
    """
    table = DocumentTable(spark, root)
    inserted = deleted = 0
    if requests is not None:
        key = order_by if order_by is not None else F.xxhash64(F.map_entries("fields"))
        inserted = table.insert(expand_payloads(requests).withColumn("_order", key), ("_order",), txn)
    for database, query in sorted((deletes or {}).items()):
        deleted += table.delete(database, query, (f"{txn[0]}/delete/{database}", txn[1]) if txn else None)
    return {"inserted": inserted, "deleted": deleted, "version": table.snapshot().version}


def search(spark: SparkSession, root: str, database: str, query: str) -> DataFrame:
    return DocumentTable(spark, root).find(database, query)
