"""Document tables as Parquet files and a log of commits.

A table is a folder: ``data/commit=<id>/database=<name>/`` holds documents, ``index/commit=<id>/``
says which files hold which keys, and ``log/<version>.json`` says which files a commit
adds and removes. Data is written under a new id and counts once its log entry is
there, so a job that fails at any point leaves the table as it was and can run again.
An entry is put in place only if its version is still free. A writer that comes second
looks at what came before: where that leaves its work right it takes the next
version, else it does its part again on the new state.

Inserts only add files. A delete reads the files that can match and writes again what is
left of those that do. So what is written grows with the change and not with the table.
Readers keep the version they began with; :meth:`DocumentTable.vacuum` deletes what no
version needs any more.

A version's list of files is held by the driver, as Spark's own file index is. On a mounted
file system an entry is put in place by a hard link, elsewhere by a rename that
fails if the target is there; stores without such a rename allow one writer only.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.query import compile_query, equality_key, equal_values
from logloom.sources.tail import local
from logloom.storage import BROADCAST_ROWS, numbered, running_sum, stored

DOCUMENTS = "database string, _id string, fields map<string,string>"
DATA = f"commit string, {DOCUMENTS}"
INDEX = "commit string, key long, file string"
#: Every so many versions an entry lists all files, so that readers need no older ones.
WHOLE_EVERY = 50
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer took the version."""


@dataclass
class Snapshot:
    """The files of a version by path, the next id of each database, and the last number of each application."""

    version: int = 0
    files: dict[str, dict] = field(default_factory=dict)
    next_id: dict[str, int] = field(default_factory=dict)
    applied: dict[str, list[int]] = field(default_factory=dict)
    indexed: list[str] = field(default_factory=lambda: ["_id"])

    def apply(self, version: int, entry: dict) -> None:
        if entry.get("whole"):
            self.files = {}
        for path in entry["removed"]:
            del self.files[path]
        self.files |= entry["added"]
        self.next_id |= entry["next_id"]
        self.applied |= entry["applied"]
        self.indexed = entry["indexed"]
        self.version = version

    def of(self, database: str | None) -> list[str]:
        return sorted(p for p, f in self.files.items() if database is None or f["database"] == database)


class DocumentTable:
    """Documents of many databases at ``root``.

    ``indexed`` names the fields, besides ``_id``, whose values a new table keeps in its index.
    """

    def __init__(self, spark: SparkSession, root: str, indexed: tuple[str, ...] = ()):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._mounted = self._fs.getUri().getScheme() == "file"
        self._new_indexed = list(dict.fromkeys(("_id", *indexed)))

    # Log

    def _versions(self) -> list[int]:
        where = self._path(f"{self.root}/log")
        found = self._fs.listStatus(where) if self._fs.exists(where) else []
        names = [f.getPath().getName() for f in found]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/log/{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or ``version``."""
        entries, out = [], Snapshot(indexed=self._new_indexed)
        for v in reversed([v for v in self._versions() if version is None or v <= version]):
            entries.append((v, self._entry(v)))
            if entries[-1][1].get("whole"):
                break
        for v, entry in reversed(entries):
            out.apply(v, entry)
        if version is not None and out.version != version:
            raise ValueError(f"there is no version {version}")
        return out

    def _publish(self, version: int, entry: dict) -> None:
        """Puts a log entry in place, or raises :class:`Conflict` if its version is taken."""
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        new, final = f"{self.root}/log/.{uuid.uuid4().hex}.new", f"{self.root}/log/{version:020d}.json"
        out = self._fs.create(self._path(new), True)
        out.write(json.dumps(entry).encode())
        out.close()
        try:
            if self._mounted:
                os.link(local(new), local(final))
            else:
                self._rename(new, final)
        except FileExistsError as e:
            raise Conflict(str(version)) from e
        finally:
            self._fs.delete(self._path(new), False)

    def _rename(self, new: str, final: str) -> None:
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(new).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(new), self._path(final), how)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise FileExistsError(final) from e
            raise

    def _commit(self, base: Snapshot, added: dict, removed: list[str], next_id: dict, txn: tuple[str, int] | None, result: int) -> int:
        version = base.version + 1
        entry = {"added": added, "removed": removed, "next_id": next_id, "applied": {txn[0]: [txn[1], result]} if txn else {}, "indexed": base.indexed}
        if version % WHOLE_EVERY == 0:
            now = Snapshot(base.version, dict(base.files), dict(base.next_id), dict(base.applied), base.indexed)
            now.apply(version, entry)
            entry = {"whole": True, "added": now.files, "removed": [], "next_id": now.next_id, "applied": now.applied, "indexed": now.indexed}
        self._publish(version, entry)
        return version

    # Files

    def _write(self, docs: DataFrame, indexed: list[str]) -> dict[str, dict]:
        """Writes documents under a new id, and their index; what the log says of each file, by path."""
        commit = f"commit={uuid.uuid4().hex}"
        docs.select("database", "_id", "fields").write.partitionBy("database").parquet(f"{self.root}/data/{commit}")
        if not self._fs.globStatus(self._path(f"{self.root}/data/{commit}/database=*")):
            return {}
        made = self._files([f"{self.root}/data/{commit}"]).withColumn("file", F.col("_metadata.file_path"))
        number = F.col("_id").try_cast("long")
        about = made.groupBy("database", "file").agg(F.count("*").alias("rows"), F.max(number).alias("most"), F.max("_metadata.file_size").alias("size"))
        keys = F.array(*[key_of(F.col("database"), name, equality_key(F.col("_id") if name == "_id" else F.try_element_at("fields", F.lit(name)))) for name in indexed])
        index = made.select(F.explode(keys).alias("key"), "file").where("key is not null").distinct()
        index.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.root}/index/{commit}")
        return {self._relative(r["file"]): {"database": r["database"], "rows": r["rows"], "most": r["most"], "size": r["size"]} for r in about.collect()}  # one row a file

    def _relative(self, uri: str) -> str:
        return unquote(uri).rsplit("/data/commit=", 1)[1].join(("commit=", ""))

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(DATA).option("basePath", f"{self.root}/data").parquet(*paths)

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], DOCUMENTS)
        return self._files([f"{self.root}/data/{p}" for p in paths])

    # Reading

    def read(self, database: str | None = None, version: int | None = None) -> DataFrame:
        """``database, _id, fields`` of a version; of one database only its files are read."""
        return self._read(self.snapshot(version).of(database)).select("database", "_id", "fields")

    def find(self, database: str, query: str | dict) -> DataFrame:
        """Documents that match. Where the query asks for values of indexed fields, only files that hold them are read."""
        snap = self.snapshot()
        return self._read(self._candidates(snap, database, query)).select("database", "_id", "fields").where(compile_query(query))

    def get(self, database: str, doc_id: str) -> DataFrame:
        """The document of one id."""
        return self.find(database, {"_id": {"$eq": doc_id}}).where(F.col("_id") == doc_id)

    def _candidates(self, snap: Snapshot, database: str, query: str | dict) -> list[str]:
        """The files of a database that can match, by the index."""
        paths = snap.of(database)
        for name in snap.indexed:
            values = equal_values(query, name)
            if values is None or not paths:
                continue
            commits = sorted({p.split("/")[0] for p in paths})
            wanted = [key_of(F.lit(database), name, equality_key(F.lit(v))) for v in values]
            index = self.spark.read.schema(INDEX).option("basePath", f"{self.root}/index").parquet(*[f"{self.root}/index/{c}" for c in commits])
            hit = index.where(F.col("key").isin(*wanted)).select("file").distinct() if wanted else index.limit(0)
            found = {self._relative(r[0]) for r in hit.collect()}  # paths, of which the driver has all
            paths = [p for p in paths if p in found]
        return paths

    # Writing

    def _attempt(self, txn: tuple[str, int] | None, work: Callable[[Snapshot], int | None]) -> int:
        """Runs ``work`` on the newest version until it commits; a number of an application that is there already changes nothing."""
        for turn in range(ATTEMPTS):
            snap = self.snapshot()
            if txn and snap.applied.get(txn[0], [-1])[0] >= txn[1]:
                return snap.applied[txn[0]][1] if snap.applied[txn[0]][0] == txn[1] else 0
            try:
                return work(snap)
            except Conflict:
                time.sleep(min(0.05 * 2**turn, 2.0))
        raise Conflict(f"no free version of {self.root} in {ATTEMPTS} attempts")

    def insert(self, new_docs: DataFrame, order_by: tuple[str, ...], txn: tuple[str, int] | None = None) -> int:
        """Adds documents (``database, fields`` and the columns of ``order_by``) with the next ids of their database; the number of them.

        Rows without fields are rejected. ``txn`` is an application and a number that grows: what was committed under it is not
        done again. An id is never given twice, also after a delete.
        """

        def number() -> tuple[DataFrame, dict[str, int]]:
            rows = stored(numbered(new_docs.where("fields is not null").drop("_id"), "database", order_by, "_number").select("database", "fields", "_number"), "numbered")
            return rows, {r[0]: r[1] for r in rows.groupBy("database").count().collect()}  # one row a database

        return self._insert(number, txn)

    def insert_lists(self, lists: DataFrame, order_by: tuple[str, ...], txn: tuple[str, int] | None = None) -> int:
        """As :meth:`insert`, of rows that hold many documents each: ``database``, ``fields``, an array of ``n``, and the columns of ``order_by``.

        Only the lengths of lists are numbered; documents are not sorted. ``order_by`` tells the lists of a database apart, and
        ``lists`` is read more than once, so it should be a table.
        """

        def number() -> tuple[DataFrame, dict[str, int]]:
            ends = stored(running_sum(lists.where("n > 0").select("database", *order_by, F.col("n").cast("long").alias("_n")), "database", order_by, "_n", "_upto"), "ends")
            few = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            places = ends.select("database", *order_by, (F.col("_upto") - F.col("_n")).alias("_before"))
            rows = lists.join(F.broadcast(places) if few else places, ["database", *order_by])
            rows = rows.select("database", "_before", F.posexplode("fields").alias("_place", "fields")).select("database", "fields", (F.col("_before") + F.col("_place")).alias("_number"))
            return rows, {r[0]: r[1] for r in ends.groupBy("database").agg(F.max("_upto")).collect()}  # one row a database

        return self._insert(number, txn)

    def _insert(self, number: Callable[[], tuple[DataFrame, dict[str, int]]], txn: tuple[str, int] | None) -> int:
        """Inserts what ``number`` tells: ``database, fields, _number``, dense from 0 inside a database, and how many each database gets."""
        rows = None
        counts: dict[str, int] = {}
        done: dict = {}

        def work(snap: Snapshot) -> int:
            nonlocal rows, counts
            if rows is None:  # numbered once, whatever other writers do
                rows, counts = number()
            if not done or any(snap.next_id.get(d, 1) != n for d, n in done["start"].items()):
                start = {d: snap.next_id.get(d, 1) for d in counts}
                given = self.spark.createDataFrame(sorted(start.items()), "database string, _start long") if start else None
                ids = rows.join(F.broadcast(given), "database").withColumn("_id", (F.col("_number") + F.col("_start")).cast("string")) if start else None
                done.update(start=start, added=self._write(ids, snap.indexed) if start else {})
            total = sum(counts.values())
            if total or txn:
                self._commit(snap, done["added"], [], {d: done["start"][d] + n for d, n in counts.items()}, txn, total)
            return total

        return self._attempt(txn, work)

    def load(self, docs: DataFrame) -> int:
        """Adds documents with ids of their own; the number of them. Ids given later are greater than the greatest number among them."""

        done: dict = {}

        def work(snap: Snapshot) -> int:
            if not done:
                done["added"] = self._write(docs, snap.indexed)
            next_id: dict[str, int] = {}
            for f in done["added"].values():
                next_id[f["database"]] = max(next_id.get(f["database"], snap.next_id.get(f["database"], 1)), (f["most"] or 0) + 1)
            if done["added"]:
                self._commit(snap, done["added"], [], next_id, None, 0)
            return sum(f["rows"] for f in done["added"].values())

        return self._attempt(None, work)

    def delete(self, database: str, query: str | dict, txn: tuple[str, int] | None = None) -> int:
        """Removes the documents of a database that match; the number of them."""
        hit = compile_query(query)
        done: dict = {}

        def work(snap: Snapshot) -> int:
            paths = self._candidates(snap, database, query)
            if not done or done["paths"] != paths:  # else what came between left these files as they were
                seen = self._read(paths).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count_if(hit).alias("n"), F.count("*").alias("rows")) if paths else None
                found = {self._relative(r["file"]): r for r in seen.where("n > 0").collect()} if paths else {}  # one row a file
                partly = [p for p, r in found.items() if r["n"] < r["rows"]]
                added = self._write(self._read(partly).where(~hit), snap.indexed) if partly else {}
                done.update(paths=paths, removed=sorted(found), added=added, n=sum(r["n"] for r in found.values()))
            if done["removed"] or txn:
                self._commit(snap, done["added"], done["removed"], {}, txn, done["n"])
            return done["n"]

        return self._attempt(txn, work)

    def compact(self, database: str, file_bytes: int = 128 << 20) -> int:
        """Joins files of a database that are below half of ``file_bytes``; the number of files joined."""

        def work(snap: Snapshot) -> int:
            small = [p for p in snap.of(database) if snap.files[p]["size"] * 2 < file_bytes]
            if len(small) < 2:
                return 0
            size = sum(snap.files[p]["size"] for p in small)
            added = self._write(self._read(small).repartitionByRange(max(1, -(-size // file_bytes)), F.col("_id").try_cast("long"), "_id"), snap.indexed)
            self._commit(snap, added, small, {}, None, 0)
            return len(small)

        return self._attempt(None, work)

    def vacuum(self, keep_versions: int = 10, older_than_sec: float = 7 * 86400) -> int:
        """Deletes folders that the last ``keep_versions`` versions do not need and that have not changed for so long; the number of them.

        A writer that has not committed yet is safe as long as it takes less than ``older_than_sec``.
        """
        versions = self._versions()[-max(keep_versions, 1) :]
        needed = {p.split("/")[0] for v in versions for p in self.snapshot(v).files}
        gone, now = 0, time.time()
        for part in ("data", "index"):
            where = self._path(f"{self.root}/{part}")
            for f in self._fs.listStatus(where) if self._fs.exists(where) else []:
                if f.getPath().getName() not in needed and now - f.getModificationTime() / 1000 >= older_than_sec:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        return gone


def key_of(database: Column, name: str, value: Column) -> Column:
    """The key of a field's value in the index; NULL for none."""
    return F.when(value.isNotNull(), F.xxhash64(database, F.lit(name), value))
