"""Canonical exact fingerprints of documents.

A text is brought to a canonical form (NFKC, case folding, white space folded to
single blanks) and digested with 128-bit xxhash. Documents are grouped by that
digest; where a bucket holds more than one row, the canonical bytes themselves
are compared, and texts that differ in spite of an equal digest get a further
number, so equal fingerprints mean equal canonical texts.

The likeness of two fingerprints is 1.0 when the canonical bytes are equal and
0.0 otherwise: an exact digest knows no degrees.

Nulls: a null text is the empty text. Repeated rows keep their rows and equal
fingerprints. Rows with equal or null ``doc_id`` are ordered by text (nulls
first). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.shared import documents, stored, text_or_empty


#: So many digests (about 60 bytes each) may go to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def canonical(text: str) -> str:
    """NFKC, full case folding, NFKC again (folding can undo it), blanks folded."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def mark(canon: str) -> int:
    """A second hash, which tells texts of one digest apart without sending them."""
    return xxhash.xxh3_64_intdigest(canon.encode("utf-8", "surrogatepass"), seed=1) - (1 << 63)


def canonical_texts(docs: DataFrame, name=digest) -> DataFrame:
    def run(batches):
        for batch in batches:
            canon = [canonical(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([name(c) for c in canon], pa.string()), pa.array([mark(c) for c in canon], pa.int64()), pa.array(canon, pa.string())], ["digest", "mark", "canon"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "digest string, mark long, canon string")


def numbered_collisions(docs: DataFrame, repeated: DataFrame, name=digest) -> DataFrame:
    """``digest, mark, canon, variant`` of texts that differ though their digests are equal.

    Only buckets with more than one row are looked at. Each map task reduces a
    bucket to its least and greatest canonical text before the shuffle, so a
    group of copies costs one row a task, however many copies there are; only
    buckets where the two differ are listed in full.
    """
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    inside = canonical_texts(docs, name).join(F.broadcast(repeated) if few else repeated.hint("merge"), "digest", "left_semi")
    unequal = inside.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least != most").select("digest")
    listed = inside.join(unequal, "digest", "left_semi").distinct()
    return listed.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1)


_PAIR = "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, same_edited boolean, same_next boolean, mark long"
_WALK = f"{_PAIR}, part int, edge string, text string"


def _pair(name, doc_id, text: str, own: str, following: str, after: str) -> tuple:
    """A text and the next one, both with their canonical form."""
    changed = edited(text, following)
    other = canonical(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), name(own), name(other), own == other, own == after, mark(own)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.string()), ("edited_digest", pa.string()), ("same_edited", pa.bool_()), ("same_next", pa.bool_()), ("mark", pa.int64())]
_EDGES = [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _walk(name):
    """Pairs each text with the next one of its sorted partition; the partition's first and last are also told."""

    def run(batches):
        from pyspark import TaskContext

        part, before, first = TaskContext.get().partitionId(), None, True
        nothing = (None,) * len(_FIELDS)
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                text = texts[i].as_py()
                canon = canonical(text)
                if first:
                    rows.append((*nothing, part, "first", text))
                    first = False
                if before is not None:
                    rows.append((*_pair(name, *before, text, canon), part, None, None))
                before = (doc_id, text, canon)
            yield _batch(rows, _FIELDS + _EDGES)
        if before is not None:
            yield _batch([(before[0], *nothing[1:], part, "last", before[1])], _FIELDS + _EDGES)

    return run


def _finish(name):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            yield _batch([_pair(name, doc_id, own, canonical(own), following, canonical(following)) for doc_id, own, following in rows], _FIELDS)

    return run


def compared_with_next(docs: DataFrame, name=digest) -> DataFrame:
    """Every document beside its edited text and the next document by ascending ``doc_id``.

    Texts move once, in a range partitioning by ``doc_id``. Inside a partition the
    walk is local; across partitions only the first and last text of each meet,
    one row a partition, never the whole column.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    walked = stored(ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_walk(name), _WALK), "walked")
    firsts = walked.where("edge = 'first'").select("part", "text")
    # One row a partition: the order of partitions that hold rows, and after the last the first.
    parts = firsts.select("part")
    order = Window.orderBy("part")
    after = parts.withColumn("after", F.lead("part").over(order)).crossJoin(F.broadcast(parts.agg(F.min("part").alias("least")))).select("part", F.coalesce("after", "least").alias("after"))
    lasts = walked.where("edge = 'last'").select("doc_id", F.col("text").alias("own"), "part")
    ends = lasts.join(after, "part").join(firsts.select(F.col("part").alias("after"), F.col("text").alias("following")), "after")
    finished = ends.select("doc_id", "own", "following").mapInArrow(_finish(name), _PAIR)
    return walked.where("edge is null").select(*[n for n, _ in _FIELDS]).unionByName(finished)


def fingerprinted(docs: DataFrame, name=digest) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and the likeness of the two and of the next document's."""
    rows = stored(compared_with_next(docs, name), "fingerprints")
    repeated = rows.groupBy("digest").count().where("count > 1").select("digest")
    collisions = stored(numbered_collisions(docs, repeated, name).where("variant > 0").select("digest", "mark", "variant"), "collisions")
    named = rows.withColumns({"fingerprint": F.col("digest"), "edited_fingerprint": F.col("edited_digest")})
    if not collisions.isEmpty():  # never seen with 128 bits; the texts have decided then
        suffix = F.when(F.col("variant").isNotNull(), F.concat(F.lit("-"), F.col("variant").cast("string"))).otherwise("")
        named = named.join(collisions.hint("merge"), ["digest", "mark"], "left").withColumns({"fingerprint": F.concat("digest", suffix), "edited_fingerprint": F.concat("edited_digest", F.when(F.col("same_edited"), suffix).otherwise(""))})
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("same_edited").cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(documents(spark, sf_dir))
