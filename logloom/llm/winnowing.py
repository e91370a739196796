"""Benchmark decontamination by winnowing.

ASCII capitals are lowered; words are runs of ASCII letters, digits and characters
beyond ASCII. An item's windows are its runs of ``SPAN`` words; an item of fewer
words, but not none, is one window.

1. *Winnow.* A window's fingerprint is the least hash of the ``GRAM``-word phrases in
   it (the leftmost of equal ones). Equal windows have equal fingerprints, wherever
   they stand, so every shared span of ``SPAN`` words or more is met, while about
   two of ``SPAN - GRAM + 2`` phrases are ever kept. The fingerprint of a short item
   is the hash of all of its words.
2. *Join.* Fingerprints of documents meet those of items. Up to ``FINGERPRINTS``
   different ones of items (32 MB) go to every task, so that nothing else of the
   documents moves; more are met by a shuffle.
3. *Extend.* Around a fingerprint that was met, the windows that chose it are sent in
   words, once for each document and different window, and joined with the items'
   windows. So hashes only propose, and words decide.

Nulls: a null text has no words. Rows with equal or null ids are told apart by their
texts; repeated rows keep their rows. Items of one id are one item; items
without an id count as hits but are not listed. Without items, or without
documents, nothing is hit. Other columns are ignored or, in :func:`decontaminated`, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import documents, stored, table, text_or_empty
from logloom.llm.wordhash import least_in_runs, phrase_hashes, text_chunks, words_of

SPAN = 10
GRAM = 5
#: So many fingerprints of items, of 8 bytes, go to every task.
FINGERPRINTS = 4_000_000
#: Windows of items of so many bytes go to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[48:58] = SEPARATORS[97:123] = SEPARATORS[128:] = False

FOUND = pa.list_(pa.struct([("window", pa.string()), ("starts", pa.list_(pa.int32()))]))
WALKED = "doc_id long, row long, n_words long, found array<struct<window string, starts array<int>>>"


def fingerprints(word_hash: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of every window of ``k`` words."""
    if k < SPAN:
        return phrase_hashes(word_hash, k)
    phrases = phrase_hashes(word_hash, GRAM)
    return phrases[least_in_runs(phrases, SPAN - GRAM + 1)] if len(word_hash) >= SPAN else phrases[:0]


def _chunks(column: pa.Array):
    """``(row from, row to, words)`` of runs of texts."""
    for lo, hi, data, offsets in text_chunks(column):
        yield lo, hi, words_of(data, offsets, lower=True, separators=SEPARATORS)


def _word(words, i: int) -> bytes:
    return words.data[words.start[i] : words.end[i]].tobytes()


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, k, fingerprint, window`` for every window of every item, once each."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for lo, hi, w in _chunks(batch.column(1)):
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    k = min(SPAN, b - a)
                    if not k:
                        continue
                    texts = [_word(w, x) for x in range(a, b)]
                    prints = fingerprints(w.hash[a:b], k).astype(np.int64).tolist()
                    seen = {b" ".join(texts[x : x + k]): p for x, p in enumerate(prints)}
                    for column, values in zip(out, ([batch.column(0)[lo + i].as_py()] * len(seen), [k] * len(seen), seen.values(), (t.decode() for t in seen)), strict=True):
                        column.extend(values)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["item_id", "k", "fingerprint", "window"])

    return items.select(F.col("item_id").cast("string"), text_or_empty().alias("text")).mapInArrow(run, "item_id string, k int, fingerprint long, window string").distinct()


def _valid(words, k: int) -> np.ndarray:
    """Whether the window at each word ends in the text it starts in."""
    n = len(words.hash) - k + 1
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    return text[:n] == text[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def _met(prints: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``prints`` are among the sorted ``wanted``; runs of one fingerprint are looked up once."""
    if not len(prints) or not len(wanted):
        return np.zeros(len(prints), dtype=bool)
    new = np.concatenate([[True], prints[1:] != prints[:-1]])
    few = prints[new]
    at = np.minimum(np.searchsorted(wanted, few), len(wanted) - 1)
    return (wanted[at] == few)[np.cumsum(new) - 1]


def _candidates(words, lengths: list[int], wanted: np.ndarray, texts: int) -> list:
    """For each text its windows whose fingerprints were met, with their starts; None for none."""
    found: list = [None] * texts
    for k in lengths:
        places = np.flatnonzero(_met(fingerprints(words.hash, k), wanted) & _valid(words, k))
        for i, p in zip((np.searchsorted(words.first, places, side="right") - 1).tolist(), places.tolist(), strict=True):
            found[i] = found[i] if found[i] is not None else {}
            window = b" ".join([_word(words, x) for x in range(p, p + k)])
            found[i].setdefault(window, []).append(p - int(words.first[i]))
    return [f and [{"window": t.decode(), "starts": s} for t, s in f.items()] for f in found]


def _walked(docs: DataFrame, lengths: list[int], wanted) -> DataFrame:
    """``docs`` is ``doc_id, row, text`` and, where ``wanted`` is None, ``wanted``: the fingerprints that each text met."""

    def run(batches):
        shared = None if wanted is None else wanted.value
        for batch in batches:
            n_words, found = [], []
            for lo, hi, w in _chunks(batch.column(2)):
                n_words += np.diff(w.first).tolist()
                own = shared
                if own is None:  # more than a text's own: words decide in the end
                    own = np.unique(np.array(batch.column(3).slice(lo, hi - lo).flatten(), dtype=np.int64).view(np.uint64))
                found += _candidates(w, lengths, own, hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(found, FOUND)], ["doc_id", "row", "n_words", "found"])

    return docs.mapInArrow(run, WALKED)


def _met_by_shuffle(docs: DataFrame, lengths: list[int], windows: DataFrame) -> DataFrame:
    """``docs`` with the fingerprints of each text that items have, too, as ``wanted``."""

    def run(batches):
        for batch in batches:
            prints = []
            for lo, hi, w in _chunks(batch.column(2)):
                for i in range(hi - lo):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    prints.append(np.unique(np.concatenate([fingerprints(h, k) for k in lengths])).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.list_(pa.int64()))], ["doc_id", "row", "prints"])

    sent = docs.mapInArrow(run, "doc_id long, row long, prints array<long>").select("doc_id", "row", F.explode("prints").alias("fingerprint"))
    met = sent.join(windows.select("fingerprint").distinct().hint("merge"), "fingerprint", "left_semi")
    own = stored(met.groupBy("doc_id", "row").agg(F.collect_set("fingerprint").alias("wanted")), "met")
    return _beside(docs, own).withColumn("wanted", F.coalesce("wanted", F.array().cast("array<long>")))


def _beside(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` and what ``more`` holds for their ids and texts; ids may be null."""
    more = more.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    return rows.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").drop("_id", "_row")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(batches):
    """Overlapping and touching windows of a document as spans of words."""
    for batch in batches:
        spans = []
        for hits in batch.column(2).to_pylist():
            covered = sorted((s, s + h["k"]) for h in hits for s in h["starts"])
            out: list[list[int]] = []
            for a, b in covered:
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            spans.append([{"start": a, "end": b} for a, b in out])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS), batch.column(3)], ["doc_id", "row", "spans", "items"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, row, n_words, spans, items`` for every row of ``docs``.

    ``row`` is a hash of the text; ``spans`` are the hit words as ``[start, end)``, and
    ``items`` the sorted ids of the items with windows in the document; both are empty arrays where nothing is hit.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text")
    windows = stored(item_windows(items), "windows")
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())  # ten at most
    prints = windows.select("fingerprint").distinct()
    few = prints.limit(FINGERPRINTS + 1).count() <= FINGERPRINTS
    if few:
        values = prints.toPandas()["fingerprint"].to_numpy(dtype=np.int64)
        walked = _walked(rows, lengths, spark.sparkContext.broadcast(np.sort(values.view(np.uint64))))
    else:
        walked = _walked(_met_by_shuffle(rows, lengths, windows), lengths, None)
    walked = stored(walked, "walked")
    found = walked.where("found is not null")
    sent = found.select("doc_id", "row", F.inline("found"))
    different = windows.select("window", "k").distinct()
    size = different.agg(F.sum(F.octet_length("window") + 32)).first()[0] or 0
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df.hint("merge"))
    hits = sent.join(small(different), "window").select("doc_id", "row", F.struct("k", "starts").alias("hit"), F.lit(None).cast("string").alias("item_id"))
    ids = windows.select("window", "item_id").where("item_id is not null")
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES and ids.limit(FINGERPRINTS + 1).count() * 64 <= BROADCAST_BYTES else (lambda df: df.hint("merge"))
    named = sent.select("doc_id", "row", "window").join(small(ids), "window").select("doc_id", "row", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), "item_id").distinct()
    met = hits.unionByName(named).groupBy("doc_id", "row").agg(F.collect_set("hit").alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = met.select("doc_id", "row", "hits", "items").mapInArrow(_merged, "doc_id long, row long, spans array<struct<start int, end int>>, items array<string>")
    none = {"spans": F.array().cast("array<struct<start int, end int>>"), "items": F.array().cast("array<string>")}
    extended = _beside(found.select("doc_id", "row", "n_words"), spans).withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return walked.where("found is null").select("doc_id", "row", "n_words").withColumns(none).unionByName(extended)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of an item; columns as before."""
    hit = contamination(docs, items).where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(hit["hit_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["hit_row"])
    return docs.join(hit, same, "left_anti")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    hit = hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + 9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
h AS (SELECT dw.*, iw.item_id FROM dw JOIN iw ON iw.g = dw.g),
x AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(x.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, x.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
