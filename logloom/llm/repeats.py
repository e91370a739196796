"""Repeated passages: automata that locate every occurrence, and their removal.

A window is ``WINDOW`` consecutive words. A window's *anchor* is the phrase of
``ANCHOR`` words in it with the least hash (the leftmost of equal ones), so equal
windows have equal anchors, and only one phrase in about six is an anchor.

1. *Copies.* Documents with the same words are one class; the later ones lose
   all words, if they have a window at all, and take no further part.
2. *Confirm.* Anchors of all documents meet by hash; documents that share one send its
   words on. A phrase whose words two occurrences sent is a confirmed phrase.
3. *Locate.* Documents are dealt to shards. A shard compiles the confirmed phrases that
   its documents may hold, in the words that any document sent, into one Aho-Corasick
   automaton (of words joined by single blanks) and streams all of its documents through
   it. Only where it hits are there windows: those whose anchor the hit is.
4. *Compare.* Of equal located windows of a shard the earliest (smaller ``doc_id``, then
   earlier start) meets those of the other shards. Every one but the earliest of all
   covers its words, and covered words are removed.

Nothing knows of a window before an automaton has located its phrase, so without
automata only whole copies are removed. Documents with located windows are kept in a
table beside their windows; all others are done with the stream.

Windows are compared by two 64-bit hashes, so a false match has a chance of about
1e-38 for each pair. Nulls: null text has no words. Rows with
a null ``doc_id`` are returned unchanged. Repeated rows (equal ``doc_id`` and
text) are one document and stay alike; of rows with one id and different texts the
least text takes part and the others are returned unchanged. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.jaccard import classes_of, one_text_each, only_representatives
from logloom.llm.packed_rows import PACKED, TO_OWNERS, bucket_of, gathered_by_owner, pack, to_owners, unpack
from logloom.llm.shared import documents, stored, text_or_empty
from logloom.llm.wordhash import least_in_runs, mix, rolling_phrase_hashes, text_chunks, words_of

WINDOW = 20
ANCHOR = 10
#: Words of the documents that one automaton serves, about.
SHARD_WORDS = 400_000

_S1 = np.uint64(0x9AE16A3B2F90404F)


def _members(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                w = words_of(data, offsets)
                for i in range(hi - lo):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    place = mix(np.arange(1, len(h) + 1, dtype=np.uint64))
                    out[0].append(len(h))
                    out[1].append(int(mix(h + place).sum(dtype=np.uint64).astype(np.int64)))
                    out[2].append(int((mix(h ^ _S1) * (place | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "n", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def anchors(word_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase hashes, place of the anchor of every window)`` of one text with a window at least."""
    phrases = rolling_phrase_hashes(word_hash, ANCHOR)
    return phrases, least_in_runs(phrases, WINDOW - ANCHOR + 1)


def _texts_with_windows(column: pa.Array):
    """``(row, words, first word, last word)`` of the texts that have a window."""
    for lo, hi, data, offsets in text_chunks(column):
        w = words_of(data, offsets)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= WINDOW:
                yield lo + i, w, a, b


def _recurring(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, hashes``: packed hashes of the recurring anchors of each document."""

    def run(batches):
        for batch in batches:
            ids, hashes, owners = batch.column(0).to_numpy(), [], []
            for row, w, a, b in _texts_with_windows(batch.column(1)):
                phrases, at = anchors(w.hash[a:b])
                h = phrases[at[np.concatenate([[True], at[1:] != at[:-1]])]]
                hashes.append(h)
                owners.append(np.full(len(h), ids[row]))
            if hashes:
                yield pack(np.concatenate(hashes), np.concatenate(owners), buckets)

    def meet(t: pa.Table) -> pa.Table:
        h, i = unpack(t)
        order = np.lexsort((i, h))
        h, i = h[order], i[order]
        same = h[1:] == h[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return to_owners(i[twice], h[twice], buckets)

    sent = docs.mapInArrow(run, PACKED)
    # Rows of bytes to the documents' owners, so their number follows the tasks and not documents times buckets.
    return gathered_by_owner(sent.groupBy("bucket").applyInArrow(meet, TO_OWNERS), "uint64", "hashes")


def _words(w, a: int, b: int) -> bytes:
    """Words ``a .. b - 1`` joined by single blanks, with one before and one behind."""
    return b" " + bytes(w.data[w.start[a] : w.end[b - 1]]).translate(_TO_BLANK) + b" "


_TO_BLANK = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def _single_blanks(raw: bytes) -> bytes:
    return b" " + b" ".join(raw.split()) + b" " if b"  " in raw[1:-1] else raw


def _line(words, a: int, b: int) -> tuple[str, np.ndarray]:
    """The words joined by single blanks, one character a byte, and the places of the blanks before each word."""
    raw = _single_blanks(_words(words, a, b))
    return raw.decode("latin-1"), np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each document, as :func:`_shard_column`; ids in steps spread, as ``shards`` is a prime."""
    return ((ids ^ (ids >> 17)) % shards).astype(np.int32)


def _shard_column(doc_id: Column, text: Column, shards: int) -> Column:
    """Rows without an id are dealt by their text."""
    key = F.coalesce(doc_id.bitwiseXOR(F.shiftright(doc_id, 17)), F.xxhash64(text))
    return F.pmod(key, F.lit(shards)).cast("int")


def _prime_from(n: int) -> int:
    n = max(n, 2)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


SENT = "bucket int, shards binary, counts binary, phrases binary"
TO_SHARDS = "shard int, phrases binary, copy long"
DONE = "doc_id long, n_words long, n_located long, n_removed long, kept_sha256 string"
#: A document that is done, or else its text, its windows that came later in its shard, and those that others must see.
LOCATED = f"{DONE}, text string, later binary, hashes binary, checks binary, starts binary"
WINDOWS = "bucket int, hashes binary, checks binary, ids binary, starts binary"
#: Marked windows of so many bytes may go to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_keys):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_keys)) + 1, [len(sorted_keys)]])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


class Sent:
    """Recurring phrases in words of a run of documents, by bucket."""

    def __init__(self, shards: int, buckets: int):
        self.shards, self.buckets = shards, buckets
        self.phrases: dict[tuple[int, int, bytes], int] = {}  # bucket, shard and words: occurrences
        self.words = 0

    def add(self, doc_id: int, words, a: int, b: int, recurring: np.ndarray) -> None:
        phrases, at = anchors(words.hash[a:b])
        mine = np.unique(at[np.isin(phrases, recurring)[at]])
        if not len(mine):
            return
        line, blanks = _line(words, a, b)
        shard = int(shard_of(np.array([doc_id]), self.shards)[0])
        for bucket, p in zip(bucket_of(phrases[mine], self.buckets).tolist(), mine.tolist(), strict=True):
            key = (bucket, shard, line[blanks[p] + 1 : blanks[p + ANCHOR]].encode("latin-1"))
            self.phrases[key] = self.phrases.get(key, 0) + 1
        self.words += b - a

    def batch(self) -> pa.RecordBatch | None:
        by_bucket: dict[int, list] = {}
        for (bucket, shard, words), n in self.phrases.items():
            by_bucket.setdefault(bucket, []).append((shard, n, words))
        rows = []
        for bucket, found in by_bucket.items():
            shards, counts, words = zip(*found, strict=True)
            rows.append((bucket, np.array(shards, dtype=np.int32).tobytes(), np.array(counts, dtype=np.int32).tobytes(), b"\n".join(words)))
        return _batch(rows, SENT) if rows else None


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _confirmed_phrases(t: pa.Table) -> dict[int, list[bytes]]:
    """The phrases that two occurrences sent in the same words, for each shard that asks for them."""
    asked: dict[bytes, tuple[int, set]] = {}
    for shards, counts, words in zip(*(t[n].to_pylist() for n in ("shards", "counts", "phrases")), strict=True):
        for shard, n, w in zip(np.frombuffer(shards, np.int32).tolist(), np.frombuffer(counts, np.int32).tolist(), words.split(b"\n"), strict=True):
            before, who = asked.get(w, (0, set()))
            who.add(shard)
            asked[w] = (before + n, who)
    out: dict[int, list[bytes]] = {}
    for w, (n, who) in asked.items():
        if n > 1:
            for shard in who:
                out.setdefault(shard, []).append(w)
    return out


def _phrases_for_shards(docs: DataFrame, shards: int, buckets: int) -> DataFrame:
    """:data:`TO_SHARDS` of confirmed phrases; ``docs`` has ``hashes``, too."""

    def run(batches):
        sent = Sent(shards, buckets)
        for batch in batches:
            ids, known = batch.column(0).to_numpy(), batch.column(2)
            for row, w, a, b in _texts_with_windows(batch.column(1)):
                sent.add(int(ids[row]), w, a, b, np.frombuffer(known[row].as_py(), dtype=np.uint64))
                if sent.words >= SHARD_WORDS:
                    yield sent.batch()
                    sent = Sent(shards, buckets)
        if (last := sent.batch()) is not None:
            yield last

    def meet(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch([(shard, b"\n".join(words), None) for shard, words in _confirmed_phrases(t).items()], TO_SHARDS)])

    return docs.select("doc_id", "text", "hashes").mapInArrow(run, SENT).groupBy("bucket").applyInArrow(meet, TO_SHARDS)


def automaton(phrases: set[bytes]):
    """Finds phrases between blanks; None for no phrases."""
    if not phrases:
        return None
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for phrase in phrases:
        machine.add_word(f" {phrase.decode('latin-1')} ", len(phrase) + 2)
    machine.make_automaton()
    return machine


def located_windows(words, a: int, b: int, machine) -> tuple[int, np.ndarray]:
    """``(hits, starts of the windows whose anchor was hit)`` of one text with a window at least."""
    line, blanks = _line(words, a, b)
    hits = np.array([end - size + 1 for end, size in machine.iter(line)], dtype=np.int64)
    if not len(hits):
        return 0, hits
    hit = np.zeros(b - a, dtype=bool)
    hit[np.searchsorted(blanks, hits)] = True
    _, at = anchors(words.hash[a:b])
    return len(hits), np.flatnonzero(hit[at])


def _kept_sha256(words, a: int, stay: np.ndarray) -> str:
    """Digest of the words at ``stay`` joined by single blanks."""
    if not len(stay):
        return hashlib.sha256(b"").hexdigest()
    runs = np.concatenate([[0], np.flatnonzero(np.diff(stay) > 1) + 1, [len(stay)]])
    spans = zip(words.start[a + stay[runs[:-1]]], words.end[a + stay[runs[1:] - 1]], strict=True)
    return hashlib.sha256(b" ".join(b" ".join(words.data[x:y].tobytes().split()) for x, y in spans)).hexdigest()


def _earliest(h: np.ndarray, c: np.ndarray, i: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows, and in it which is the first of equal ones and which is a later occurrence."""
    order = np.lexsort((s, i, c, h))
    h, c, i, s = h[order], c[order], i[order], s[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    least = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, first, (i != i[least]) | (s != s[least])  # a repeated row is the same occurrence, not an earlier one


def shard_located(docs: pa.Table, known: pa.Table) -> pa.Table:
    """:data:`LOCATED` of the documents of one shard (``doc_id, text, apart``), streamed through its automaton; ``known`` are its :data:`TO_SHARDS`."""
    machine = automaton({p for blob in known["phrases"].to_pylist() if blob is not None for p in blob.split(b"\n")})
    copies = {c for c in known["copy"].to_pylist() if c is not None}
    doc_ids, apart = docs["doc_id"].to_pylist(), docs["apart"].to_pylist()
    rows, open_, windows = [], [], []
    texts = docs["text"].combine_chunks()
    for text in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        for lo, hi, data, offsets in text_chunks(text):
            w = words_of(data, offsets)
            second = mix(w.hash ^ _S1)
            for i in range(hi - lo):
                a, b = int(w.first[i]), int(w.first[i + 1])
                doc_id, n, hits = doc_ids[len(rows)], b - a, 0
                stay = np.arange(n)
                if n >= WINDOW and doc_id is not None and not apart[len(rows)]:
                    if doc_id in copies:
                        stay = stay[:0]
                    elif machine is not None:
                        hits, at = located_windows(w, a, b, machine)
                        if len(at):
                            open_.append(len(rows))
                            windows.append((rolling_phrase_hashes(w.hash[a:b], WINDOW)[at], rolling_phrase_hashes(second[a:b], WINDOW)[at], np.full(len(at), doc_id), at.astype(np.uint32)))
                            rows.append([doc_id, n, hits, None, None, text[lo + i].as_py(), None, None, None, None])
                            continue
                rows.append([doc_id, n, hits, n - len(stay), _kept_sha256(w, a, stay), None, None, None, None, None])
    if windows:
        h, c, ids, s = (np.concatenate(x) for x in zip(*windows, strict=True))
        row = np.repeat(open_, [len(x[0]) for x in windows])
        order, first, later = _earliest(h, c, ids, s)
        for mask, fields in ((later, ((6, s),)), (first, ((7, h), (8, c), (9, s)))):
            place = order[mask]
            place = place[np.argsort(row[place], kind="stable")]
            for x, y in _runs(row[place]):
                for field, values in fields:
                    rows[int(row[place[x]])][field] = values[place[x:y]].tobytes()
    return pa.Table.from_batches([_batch([tuple(r) for r in rows], LOCATED)])


def _later_elsewhere(located: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, starts``: packed starts of the windows that also start earlier in another shard."""

    def send(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            hashes, checks, starts = ([np.frombuffer(x, t) for x in batch.column(1 + i).to_pylist()] for i, t in enumerate((np.uint64, np.uint64, np.uint32)))
            owner = np.repeat(ids, [len(x) for x in starts])
            h, c, s = np.concatenate(hashes), np.concatenate(checks), np.concatenate(starts)
            b = bucket_of(h, buckets)
            order = np.argsort(b, kind="stable")
            b, h, c, owner, s = b[order], h[order], c[order], owner[order], s[order]
            yield _batch([(int(b[x]), h[x:y].tobytes(), c[x:y].tobytes(), owner[x:y].tobytes(), s[x:y].tobytes()) for x, y in _runs(b)], WINDOWS)

    def meet(t: pa.Table) -> pa.Table:
        h, c, i, s = (np.concatenate([np.frombuffer(b, k) for b in t[n].to_pylist()]) for n, k in (("hashes", np.uint64), ("checks", np.uint64), ("ids", np.int64), ("starts", np.uint32)))
        order, _, later = _earliest(h, c, i, s)
        return to_owners(i[order[later]], s[order[later]], buckets)

    sent = located.where("hashes is not null").select("doc_id", "hashes", "checks", "starts").mapInArrow(send, WINDOWS)
    return gathered_by_owner(sent.groupBy("bucket").applyInArrow(meet, TO_OWNERS), "uint32", "starts")


def _without_covered(batches):
    """Removes the words of the later windows: ``doc_id, n_words, n_located, text, later, starts`` to :data:`DONE`."""
    for batch in batches:
        removed, kept = [], []
        later, elsewhere = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        for lo, hi, data, offsets in text_chunks(batch.column(3)):
            w = words_of(data, offsets)
            for i in range(hi - lo):
                a, b = int(w.first[i]), int(w.first[i + 1])
                marked = np.unique(np.frombuffer((later[lo + i] or b"") + (elsewhere[lo + i] or b""), dtype=np.uint32)).astype(np.int64)
                gone = np.zeros(b - a + 1, dtype=np.int64)
                gone[marked] += 1
                gone[marked + WINDOW] -= 1
                stay = np.flatnonzero(np.cumsum(gone)[: b - a] <= 0)
                removed.append(b - a - len(stay))
                kept.append(_kept_sha256(w, a, stay))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [f.split()[0] for f in DONE.split(", ")])


def streamed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_located, n_removed, kept_sha256`` for every row of ``docs``.

    ``n_located`` counts the occurrences of confirmed phrases that the shard's automaton
    located (0 for copies, which are not streamed).
    """
    spark = docs.sparkSession
    plain, others = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    members = stored(_members(plain), "members").where("doc_id is not null")
    classes = stored(classes_of(members, ["n", "d1", "d2"]), "classes")
    total = members.agg(F.sum("n")).collect()[0][0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = _prime_from(max(parts, total // SHARD_WORDS))
    reps = only_representatives(plain.where("doc_id is not null"), classes)
    recurring = stored(_recurring(reps, max(parts, total // 8_000_000)), "recurring")
    known = stored(_phrases_for_shards(reps.join(recurring, "doc_id"), shards, max(parts, total // 4_000_000)), "known")
    copies = classes.where("doc_id != rep").select("doc_id").distinct()
    known = known.unionByName(copies.select(_shard_column(F.col("doc_id"), F.lit(""), shards).alias("shard"), F.lit(None).cast("binary").alias("phrases"), F.col("doc_id").alias("copy")))
    rows = plain.withColumn("apart", F.lit(False))
    if others is not None:
        rows = rows.unionByName(others.withColumn("apart", F.lit(True)))
    rows = rows.withColumn("shard", _shard_column(F.col("doc_id"), F.col("text"), shards))
    located = stored(rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(shard_located, LOCATED), "located")
    elsewhere = stored(_later_elsewhere(located, max(parts, total // 4_000_000)), "elsewhere")
    small = (elsewhere.agg(F.sum(F.octet_length("starts") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    open_ = located.where("text is not null").select("doc_id", "n_words", "n_located", "text", "later")
    covered = open_.join(F.broadcast(elsewhere) if small else elsewhere.hint("merge"), "doc_id", "left").mapInArrow(_without_covered, DONE)
    return located.where("text is null").select("doc_id", "n_words", "n_located", "n_removed", "kept_sha256").unionByName(covered)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``."""
    return streamed(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
