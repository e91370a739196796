"""Exact n-gram Jaccard join in metric space.

Documents are sets of word shingles; one minus Jaccard similarity is a metric.
The join gives the components of the link graph, not all pairs of copies.

1. *Classes.* Equal sets are one class with its smallest id as representative.
2. *Coarse regions.* Unrelated sets all lie at a distance of about 1, where no
   pivot separates them, so regions start from what a close pair must share. A
   size class fixes how many shingles two linked sets can differ in; the hash
   range is cut into more groups than that, so by pigeonhole a linked pair agrees
   wholly on a known number of groups. Pairs that agree on that many join one
   region; the components of these pairs are the coarse regions, and no link
   crosses two of them. Shingles found in many documents are left out of the
   groups (the bound on the difference holds without them, too), so a common
   passage fills no group. Where two sets have too few other shingles for a group to
   tell anything, both name the first shingles of their prefix (rare ones first, as
   many as can be missing from a linked set, and one), of which linked sets share one.
3. *Voronoi regions.* A region of more than ``REGION`` sets gets pivots. Sets
   within ``BALL`` of a pivot form its cell; by the triangle inequality every set
   linked to one of them is at most ``BALL + radius`` away and is copied to the cell.
   Sets in no ball form one more cell, so every linked pair meets in a cell. Sets
   linked to a pivot are linked right there; they go on only if a set not linked
   to it lies within the window ``|d(x, p) - d(y, p)| <= radius``. Cells are regions
   again and recurse. A region whose cells together would cost more than half of
   itself is not divided.
4. *Small regions* are joined exactly, one matrix product for each. Regions that
   pivots do not divide are joined in tiles, pair by pair of tiles. A task gives the
   components of its links, one row a set, and not all its pairs.

Groups of copies are reduced to classes first. A group of more than ``BLOCK``
sets is chained to its smallest id instead of giving all its pairs.

Shingles are compared by 64-bit hashes: within a pair of sets a false match has
a chance below 1e-12. Nulls: null text is empty, an empty set is linked with
nothing; rows with a null ``doc_id`` are returned with a null component. Rows
with the same ``doc_id`` are one document; if their texts differ, the least text
stands for it. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.linked import components
from logloom.llm.packed_rows import bucket_of
from logloom.llm.shared import documents, stored, text_or_empty
from logloom.llm.wordhash import mix, phrase_hashes, text_chunks, words_of

REGION = 1000
#: Pivots for each REGION sets of a region, and at most.
PIVOTS = 8
MOST_PIVOTS = 512
ROUNDS = 3
#: Sets within this distance of a pivot belong to its cell.
BALL = 0.5
#: A shingle met more often, as far as batches with two of it show, is left out of groups; at most HOT_SHINGLES of them.
HOT = 16
HOT_SHINGLES = 1_000_000
#: Pairs are listed for groups of up to so many sets.
BLOCK = 16
#: Added to what a set needs, where it is of the size class of its group and not of the next lesser one.
OWN = 1 << 15
#: So many ids (about 40 bytes each) may go to every executor; more are joined by a shuffle.
BROADCAST_IDS = 400_000
BIN_SETS = 1500
#: Groups that a task packs at once.
SENT_AT_ONCE = 400_000
#: Shingles of the documents of a bucket of groups, about 100 bytes of Python memory for each of its groups.
BUCKET_SHINGLES = 500_000
#: Shingles among which a task counts those met twice or more, at 8 bytes.
COUNTED_AT_ONCE = 1 << 22
#: Bytes of text that are hashed at once, at about 50 bytes of Python memory each.
HASHED_AT_ONCE = 1 << 18

_S1, _S2 = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)


def shingle_sets(column: pa.Array, k: int):
    """Yields ``(row, sorted distinct shingle hashes)`` for every text."""
    for lo, hi, data, offsets in text_chunks(column, HASHED_AT_ONCE):
        w = words_of(data, offsets, lower=True)
        all_shingles = phrase_hashes(w.hash, k)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= k:
                yield lo + i, np.unique(all_shingles[a : b - k + 1])
            elif b > a:
                yield lo + i, phrase_hashes(w.hash[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield lo + i, np.zeros(0, dtype=np.uint64)


def _digests(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s ^ _S1).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ _S2).sum(dtype=np.uint64).astype(np.int64))


class Threshold:
    """``percent * |x or y| <= 100 * |x and y|``; its size classes and pigeonhole groups."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(self.edges[-1] * 100 // percent + 1)
        self.edges_array = np.array(self.edges, dtype=np.int64)

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.edges_array, n, side="right")) - 1

    def differ(self, both: int) -> int:
        """Most shingles that two linked sets of ``both`` shingles together differ in: (a + b) (1 - t) / (1 + t)."""
        return both * (100 - self.percent) // (100 + self.percent)

    def groups(self, c: int) -> int:
        """Groups of size class ``c`` (of the larger set): more than any pair differs in, by a quarter and 3."""
        most = self.differ(2 * (self.edges[c + 1] - 1))
        return most + most // 4 + 3

    def linked(self, shared: np.ndarray, union: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * union

    def signatures(self, s: np.ndarray, hot: np.ndarray):
        """For the own size class of a set and the next: hashes, how many of them a linked set shares at least, and whether it is the own.

        The number counts groups that are not empty. Where it is 0, the partner's may be
        more, so the groups are named nonetheless; where both have 0, the prefixes meet.
        """
        own = self.size_class(len(s))
        common = _among(s, hot)
        rest = s[~common]
        high = rest >> np.uint64(32)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(rest ^ _S1), dtype=np.uint64)])
        for c in (own, own + 1):
            n = self.groups(c)
            at = (high * np.uint64(n)) >> np.uint64(32)
            cut = np.searchsorted(at, np.arange(n + 1, dtype=np.uint64))
            held = cut[1:] > cut[:-1]
            partner = min(self.edges[c + 1] - 1, len(s) * 100 // self.percent)
            need = n - self.differ(len(s) + partner) - int((~held).sum())
            name = np.arange(n, dtype=np.uint64) | np.uint64(c << 48)
            yield mix((total[cut[1:]] - total[cut[:-1]]) + mix(name))[held], max(need, 0), c == own
            if need < 1:
                first = len(s) + 1 + (-self.percent * len(s)) // 100  # len - ceil(percent of len) + 1
                yield mix(np.concatenate([rest, s[common]])[:first] ^ mix(np.array([c], dtype=np.uint64) + _S2)), 1, c == own


def _among(s: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(s), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, s), len(sorted_values) - 1)
    return sorted_values[at] == s


def _often(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values met twice or more, and how often; ``hashes`` is sorted in place."""
    hashes.sort()
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else np.zeros(0, dtype=bool)
    start = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]])) - 1
    end = np.flatnonzero(again & ~np.concatenate([again[1:], [False]])) + 1
    return hashes[start], end - start


def _members(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents, and rows without ``n`` that count (``d2``) the shingles (``d1``) met twice or more among some of a task."""
    names = ["doc_id", "n", "d1", "d2"]
    batch_of = lambda *columns: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    def run(batches):
        # Of room that is not filled no memory is taken.
        room, filled, distinct = np.empty(COUNTED_AT_ONCE, dtype=np.uint64), 0, set()

        def counted(hashes):
            values, counts = _often(hashes)
            empty = pa.nulls(len(values), pa.int64())
            return batch_of(empty, empty, values.view(np.int64), counts)

        for batch in batches:
            n, digests = [], []
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                digests.append(_digests(s))
                if digests[-1] in distinct:  # copies count once
                    continue
                if filled + len(s) > len(room):
                    yield counted(room[:filled])
                    filled, distinct = 0, set()
                    if len(s) > len(room):
                        room = np.empty(len(s), dtype=np.uint64)
                distinct.add(digests[-1])
                room[filled : filled + len(s)] = s
                filled += len(s)
            yield batch_of(batch.column(0), n, [d[0] for d in digests], [d[1] for d in digests])
        yield counted(room[:filled])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def classes_of(members: DataFrame, digest: list[str]) -> DataFrame:
    """``members`` and ``rep``, the smallest id with the same digest; copies are summed up before they move.

    Most classes have one row and need no partner. Few others go to every task; more are
    read back from their table, so that the join has a shuffle of its own on both sides
    and a class with most rows is split at run time.
    """
    least = members.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    many = stored(least.where("copies > 1").select(*digest, "rep"), "copied")
    few = many.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = members.join(F.broadcast(many) if few else many.hint("merge"), digest, "left")
    return joined.withColumn("rep", F.coalesce("rep", "doc_id"))


def one_text_each(plain: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, text`` rows without those of an id that has a lesser text, and these, or None where there are none."""
    some = stored(plain.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if some.isEmpty():
        return plain, None
    few = some.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    least = plain.join(F.broadcast(some) if few else some.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least != most").select("doc_id", "least")
    least = stored(least, "least")
    if least.isEmpty():
        return plain, None
    marked = plain.join(least, "doc_id", "left")
    return marked.where("least is null or text = least").drop("least"), marked.where("text != least").drop("least")


def only_representatives(docs: DataFrame, classes: DataFrame) -> DataFrame:
    others = classes.where("doc_id != rep").select("doc_id").distinct()
    few = others.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(others) if few else others.hint("merge"), "doc_id", "left_anti")


_SENT = "bucket int, hashes binary, ids binary, needs binary"


def _candidate_pairs(docs: DataFrame, k: int, threshold: Threshold, hot, buckets: int) -> DataFrame:
    """``a, b``: pairs that agree on as many groups as a linked pair must, and chains of groups too large to list."""
    names = ["bucket", "hashes", "ids", "needs"]

    def packed_rows(bucket, *columns):
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        runs = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), *(pa.array([c[x:y].tobytes() for x, y in runs], pa.binary()) for c in columns)], names)

    def sent_rows(hashes, owners, needs):
        if hashes:
            h = np.concatenate(hashes)
            yield packed_rows(bucket_of(h, buckets), h, np.concatenate(owners), np.concatenate(needs))

    def run(batches):
        for batch in batches:
            ids, hashes, owners, needs, held = batch.column(0).to_numpy(), [], [], [], 0
            for row, s in shingle_sets(batch.column(1), k):
                if not len(s):
                    continue
                for sig, need, own in threshold.signatures(s, hot.value):
                    hashes.append(sig)
                    owners.append(np.full(len(sig), ids[row]))
                    needs.append(np.full(len(sig), min(need, OWN - 1) + OWN * own, dtype=np.uint16))
                    held += len(sig)
                if held > SENT_AT_ONCE:
                    yield from sent_rows(hashes, owners, needs)
                    hashes, owners, needs, held = [], [], [], 0
            yield from sent_rows(hashes, owners, needs)

    def meet(t: pa.Table) -> pa.Table:
        flat = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in t[name].to_pylist()])
        a, h, i, need = [], flat("hashes", np.uint64), flat("ids", np.int64), flat("needs", np.uint16).astype(np.int64)
        if len(h):
            order = np.lexsort((i, h))
            h, i, own, need = h[order], i[order], need[order] >= OWN, need[order] % OWN
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(start, len(h)))
            place = np.arange(len(h)) - np.repeat(start, size)
            lead, wide = np.repeat(start, size), np.repeat(size, size)
            star = (place > 0) & (wide > BLOCK) & np.repeat(np.logical_or.reduceat(own, start), size)  # large groups are chained
            a.append(np.stack([i[star], i[lead[star]], np.ones(int(star.sum()), dtype=np.int64), np.zeros(int(star.sum()), dtype=np.int64)]))
            listed = (wide <= BLOCK) & (wide > 1)
            for step in range(1, BLOCK):
                at = np.flatnonzero(listed & (place + step < wide))
                if not len(at):
                    break
                at = at[own[at] | own[at + step]]  # two sets of a lesser size class meet in that one
                a.append(np.stack([i[at + step], i[at], np.ones(len(at), dtype=np.int64), np.maximum(need[at], need[at + step])]))
        pairs = np.concatenate(a, axis=1) if a else np.zeros((4, 0), dtype=np.int64)
        pairs = pairs[:, pairs[0] != pairs[1]]
        # Counts of a bucket are summed up before they move.
        order = np.lexsort((pairs[3], pairs[1], pairs[0]))
        pairs = pairs[:, order]
        first = np.concatenate([[True], (np.diff(pairs[:2], axis=1) != 0).any(axis=0) | (np.diff(pairs[3]) != 0)]) if pairs.shape[1] else np.zeros(0, dtype=bool)
        n = np.diff(np.append(np.flatnonzero(first), pairs.shape[1]))
        return pa.table({"a": pa.array(pairs[0][first]), "b": pa.array(pairs[1][first]), "need": pa.array(pairs[3][first]), "n": pa.array(n.astype(np.int64))})

    sent = docs.mapInArrow(run, _SENT)
    met = sent.groupBy("bucket").applyInArrow(meet, "a long, b long, need long, n long")
    return met.groupBy("a", "b", "need").agg(F.sum("n").alias("n")).where("n >= need").select("a", "b").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``region, id, set``: the sets of the wanted documents (``doc_id, region``)."""

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for _, s in shingle_sets(batch.column(2), k)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(sets, pa.binary())], ["region", "id", "set"])

    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = docs.join(F.broadcast(wanted) if few else wanted.hint("merge"), "doc_id").select("doc_id", "region", "text")
    return joined.mapInArrow(run, "region long, id long, set binary")


def _as_sets(column) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in column.to_pylist()]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``|x and y|`` for all ``x`` of left and ``y`` of right, by products of 0/1 matrices over runs of shingles."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    if not left or not right:
        return out.astype(np.int64)
    both = left + right
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, dtype=bool)
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1 if len(flat) else new  # what one set has alone is shared by none
    number, owner = number[often], owner[often]
    if len(number):
        number = np.cumsum(np.concatenate([[True], number[1:] != number[:-1]])) - 1
        for lo in range(0, int(number[-1]) + 1, 4096):
            a, b = np.searchsorted(number, [lo, lo + 4096])
            m = np.zeros((len(both), min(4096, int(number[-1]) + 1 - lo)), dtype=np.float32)
            m[owner[a:b], number[a:b] - lo] = 1
            out += m[: len(left)] @ m[len(left) :].T
    return np.rint(out).astype(np.int64)


def _links(ids: np.ndarray, sets: list[np.ndarray], threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sets], dtype=np.int64)
    shared = shared_counts(sets, sets)
    ok = threshold.linked(shared, size[:, None] + size[None, :] - shared)
    a, b = np.nonzero(np.triu(ok, 1))
    return ids[a], ids[b]


def _labels(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = np.argsort(ids)
    ia, ib = at[np.searchsorted(ids[at], a)], at[np.searchsorted(ids[at], b)]
    label = ids.copy()
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        if (new == label).all():
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of the given ones: one for each set but the least of its component."""
    ids = np.unique(np.concatenate([a, b]))
    label = _labels(ids, a, b) if len(ids) else ids
    return ids[ids != label], label[ids != label]


def _small_regions(sets: DataFrame, threshold: Threshold, bins: int) -> DataFrame:
    """``node, label`` of regions that fit a task, several regions a task."""

    def join(t: pa.Table) -> pa.Table:
        region, ids = t["region"].to_numpy(), t["id"].to_numpy()
        sets = _as_sets(t["set"])
        order = np.lexsort((ids, region))
        nodes, labels = [], []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(region[order])) + 1, [len(order)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            a, b = _links(ids[own], [sets[i] for i in own], threshold)
            nodes.append(ids[own])
            labels.append(_labels(ids[own], a, b))
        return pa.table({"node": pa.array(np.concatenate(nodes), pa.int64()), "label": pa.array(np.concatenate(labels), pa.int64())})

    binned = sets.withColumn("bin", F.pmod(F.xxhash64("region"), F.lit(bins)).cast("long"))
    return binned.groupBy("bin").applyInArrow(join, "node long, label long")


#: The cell of sets in no ball.
NOWHERE = np.int64(-(1 << 63))
_CELL = "kind string, region long, id long, other long, apart double, linked boolean"


def _voronoi(sets: DataFrame, sizes: DataFrame, threshold: Threshold, turn: int) -> DataFrame:
    """One level: rows ``link`` (``id`` and ``other`` are linked, directly or over a pivot) and ``cell`` (``id`` goes to the cell of ``other``)."""
    from pyspark.sql.window import Window

    tiles = sizes.select("region", F.ceil(F.col("size") / REGION).cast("int").alias("tiles"))
    few = sizes.limit(BROADCAST_IDS // MOST_PIVOTS + 1).count() <= BROADCAST_IDS // MOST_PIVOTS  # one row for each region beyond REGION sets
    sent = F.broadcast if few else (lambda df: df)
    tiled = sets.join(sent(tiles), "region")
    # Pivots: those with the least hash. A task keeps its least ones before any row moves.
    rank = F.row_number().over(Window.partitionBy("region").orderBy("h", "id"))
    chosen = tiled.select("region", "id", F.xxhash64("id", F.lit(turn)).alias("h")).withColumn("r", rank).where(F.col("r") <= MOST_PIVOTS).join(sent(tiles), "region").where(F.col("r") <= PIVOTS * F.col("tiles")).select("region", "id")
    pivots = tiled.join(sent(chosen), ["region", "id"]).select(F.col("region").alias("p_region"), F.col("id").alias("p_id"), F.col("set").alias("p_set"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("p_tile"))
    placed = tiled.select("region", "id", "set", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"))
    reach = BALL + threshold.radius + 1e-9

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            x, p = _as_sets(left["set"]), _as_sets(right["p_set"])
            ids, pivot = left["id"].to_numpy(), right["p_id"].to_numpy()
            shared = shared_counts(x, p)
            union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in p])[None, :] - shared
            linked, apart = threshold.linked(shared, union), 1 - shared / union
            going = ~np.isin(ids, pivot)  # all links of a pivot are known
            i, j = np.nonzero(linked & (ids[:, None] != pivot[None, :]))
            one, other = _forest(ids[i], pivot[j])
            parts.append(("link", one, other, np.zeros(len(one)), np.ones(len(one), dtype=bool)))
            i, j = np.nonzero((apart <= reach) & going[:, None])
            parts.append(("cell", ids[i], pivot[j], apart[i, j], linked[i, j]))
            i = np.flatnonzero((apart.min(axis=1) > BALL) & going)
            parts.append(("cell", ids[i], np.full(len(i), NOWHERE), np.ones(len(i)), np.zeros(len(i), dtype=bool)))
        region = left["region"][0].as_py() if left.num_rows else 0
        join = lambda at, kind: np.concatenate([q[at] for q in parts]) if parts else np.zeros(0, dtype=kind)
        kinds = [q[0] for q in parts for _ in range(len(q[1]))]
        return pa.table({"kind": pa.array(kinds, pa.string()), "region": pa.array([region] * len(kinds), pa.int64()), "id": pa.array(join(1, np.int64), pa.int64()), "other": pa.array(join(2, np.int64), pa.int64()), "apart": pa.array(join(3, np.float64), pa.float64()), "linked": pa.array(join(4, bool), pa.bool_())})

    return placed.groupBy("region", "tile").cogroup(pivots.groupBy("p_region", "p_tile")).applyInArrow(meet, _CELL)


def _tiled(sets: DataFrame, sizes: DataFrame, threshold: Threshold) -> DataFrame:
    """``a, b``, links with the components of regions of any size: every pair of tiles meets in a task of its own."""
    tiles = sizes.select("region", F.ceil(F.col("size") / REGION).cast("int").alias("tiles"))
    own = sets.join(tiles, "region").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = own.select("region", "id", "set", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    placed = pairs.select("region", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"), (F.col("t") <= F.col("u")).alias("left"), "id", "set")

    def meet(t: pa.Table) -> pa.Table:
        ids, sets_, left = t["id"].to_numpy(), _as_sets(t["set"]), np.array(t["left"].to_pylist())
        if t["lo"][0].as_py() == t["hi"][0].as_py():
            a, b = _links(ids, sets_, threshold)
        else:
            li, ri = np.flatnonzero(left), np.flatnonzero(~left)
            x, y = [sets_[i] for i in li], [sets_[i] for i in ri]
            shared = shared_counts(x, y)
            union = np.array([len(s) for s in x], dtype=np.int64)[:, None] + np.array([len(s) for s in y], dtype=np.int64)[None, :] - shared
            i, j = np.nonzero(threshold.linked(shared, union))
            a, b = ids[li][i], ids[ri][j]
        a, b = _forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("region", "lo", "hi").applyInArrow(meet, "a long, b long")


def _large_regions(sets: DataFrame, threshold: Threshold) -> DataFrame:
    """``node, label`` of the regions beyond ``REGION`` sets, by recursive Voronoi cells."""
    spark = sets.sparkSession
    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    radius = threshold.radius + 1e-9
    for turn in range(ROUNDS):
        sizes = stored(sets.groupBy("region").agg(F.count("*").alias("size")), "sizes")
        if sizes.isEmpty():
            break
        level = stored(_voronoi(sets, sizes, threshold, turn), "level")
        links = links.unionByName(level.where("kind = 'link'").select(F.col("id").alias("a"), F.col("other").alias("b")))
        cells = level.where("kind = 'cell'")
        open_ = cells.groupBy("region", "other").agg(F.min(F.when(~F.col("linked"), F.col("apart"))).alias("nearest")).where("nearest is not null")
        going = stored(cells.join(open_, ["region", "other"]).where(~F.col("linked") | (F.col("apart") >= F.col("nearest") - radius)).select("region", "other", "id"), "going")
        cost = going.groupBy("region", "other").agg(F.count("*").alias("n")).groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
        # Divided where all cells together are well below the region; else the region is joined in tiles.
        worth = stored(sizes.join(cost, "region", "left").select("region", "size", (F.coalesce("cost", F.lit(0)) * 2 <= F.col("size") * F.col("size")).alias("divide")), "worth")
        whole = worth.where("not divide")
        links = links.unionByName(_tiled(sets.join(whole.select("region"), "region", "left_semi"), whole.select("region", "size"), threshold))
        moved = going.join(worth.where("divide").select("region"), "region", "left_semi").join(sets, ["region", "id"])
        following = stored(moved.select(F.xxhash64("region", "other").alias("region"), "id", "set"), "cells")
        size = stored(following.groupBy("region").agg(F.count("*").alias("size")), "sizes")
        small = size.where(F.col("size") <= REGION)
        links = links.unionByName(_tiled(following.join(small.select("region"), "region", "left_semi"), small, threshold))
        sets = following.join(size.where(F.col("size") > REGION).select("region"), "region", "left_semi")
    rest = sets.groupBy("region").agg(F.count("*").alias("size"))
    return components(links.unionByName(_tiled(sets, rest, threshold)))


def linked_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``)."""
    threshold = Threshold(percent)
    plain, others = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    counted = stored(_members(plain, k), "members")
    members = counted.where("n is not null")
    sound = members.where("n > 0 and doc_id is not null")
    often = counted.where("n is null").groupBy("d1").agg(F.sum("d2").alias("df")).where(F.col("df") >= HOT)
    values = often.orderBy(F.desc("df"), "d1").limit(HOT_SHINGLES).select("d1").toPandas()["d1"]  # a bounded list, 8 bytes each
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(values.to_numpy(dtype=np.int64).view(np.uint64)))
    classes = stored(classes_of(sound, ["n", "d1", "d2"]), "classes")
    reps = only_representatives(plain.where("doc_id is not null"), classes)
    total = sound.agg(F.sum("n")).collect()[0][0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, total // BUCKET_SHINGLES)
    families = stored(components(_candidate_pairs(reps, k, threshold, hot, buckets)), "families")
    sizes = stored(families.groupBy("label").agg(F.count("*").alias("size")), "sizes")
    large = sizes.where(F.col("size") > REGION).select(F.col("label").alias("region"))
    wanted = families.select(F.col("node").alias("doc_id"), F.col("label").alias("region"))
    sets = stored(_sets(reps, wanted, k).dropDuplicates(["region", "id"]), "sets")
    bins = max(parts, families.count() // BIN_SETS)
    labels = _small_regions(sets.join(large, "region", "left_anti"), threshold, bins).unionByName(_large_regions(sets.join(large, "region", "left_semi"), threshold))
    labels = stored(labels.where("node != label"), "labels").select(F.col("node").alias("rep"), "label")
    own = classes.select("doc_id", F.col("n"), "rep").join(labels, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    alone = members.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = own.unionByName(alone)
    return found if others is None else found.unionByName(others.select("doc_id").join(found.distinct(), "doc_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(documents(spark, sf_dir), 4, 85)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that are linked, directly or over others, to one with a smaller id; all columns kept.

    Of rows with one id and different texts the least text takes part; rows with the others stay, whatever becomes of it.
    """
    found = linked_documents(docs, k, percent)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    plain, others = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    if others is not None:
        gone = plain.join(gone, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("row")).distinct()
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "row": "gone_row"})
    on = docs["doc_id"].cast("long") == gone["gone_id"]
    if others is not None:
        on = on & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["gone_row"])
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone.hint("merge"), on, "left_anti").select(*docs.columns)
