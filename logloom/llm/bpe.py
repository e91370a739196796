"""Byte-level BPE encoding by merge replay, and decoding.

The corpus is encoded word by word, where a word is one match of the splitting
pattern. Each task holds the distinct words of its rows as one flat array of
token ids and an inverted index from token pair (by the rank of its merge) to
positions. Merges are replayed in rank order over that index: all positions of a
rank are merged at once, and only their two neighbours are looked at again. A
neighbour whose new pair has a smaller rank is replayed next, as greedy byte
pair encoding does. The words' ids then go back to every document.

Nothing is shuffled: the work is narrow, a lost task is simply run again, and
memory is bounded by the distinct words of one Arrow batch and a cache that is
emptied when full. The ranks (a file of fixed size) are read on the driver and
broadcast.

Nulls: a null text is the empty text and gives no ids. Repeated rows are
encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import documents, text_or_empty

#: Words kept from one batch to the next in a worker.
CACHE_WORDS = 500_000
#: Words replayed at once.
LEARN_WORDS = 200_000
NEVER = np.int64(1) << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _sorted_once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class MergeTable:
    """Token bytes by id, and the rank of every pair of ids that merges (sorted keys for vector lookup)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int64)[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], NEVER)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, as greedy byte pair encoding gives them."""
        out: list = [None] * len(words)
        todo = []
        for i, w in enumerate(words):
            known = self.ranks.get(w)
            if known is not None:
                out[i] = [known]
            elif w:
                todo.append(i)
            else:
                out[i] = []
        if todo:
            for i, ids in zip(todo, self._replay([words[i] for i in todo]), strict=True):
                out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        import heapq

        size = np.array([len(w) for w in words], dtype=np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(ids)
        begin = np.concatenate([[0], np.cumsum(size)])
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[begin[1:] - 1] = n  # no neighbour beyond a word
        before[begin[:-1]] = -1
        rank = np.full(n + 1, NEVER)  # rank of the pair that starts here
        inner = np.flatnonzero(after < n)
        rank[inner] = self.pair_ranks(ids[inner], ids[after[inner]])
        index: dict[int, list[np.ndarray]] = defaultdict(list)

        def enter(where: np.ndarray) -> None:
            where = where[rank[where] < NEVER]
            order = np.argsort(rank[where], kind="stable")
            where = where[order]
            if len(where):
                cuts = np.flatnonzero(np.diff(rank[where])) + 1
                for group in np.split(where, cuts):
                    r = int(rank[group[0]])
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(group)

        heap: list[int] = []
        enter(inner)
        alive = np.ones(n + 1, dtype=bool)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = _sorted_once(np.concatenate(found) if len(found) > 1 else found[0])
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # Overlapping pairs of one rank, as in aaa: the leftmost goes first, every second of a run.
            touching = np.zeros(len(at), dtype=bool)
            touching[1:] = after[at[:-1]] == at[1:]
            if touching.any():
                run = np.flatnonzero(~touching)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                # The others are looked at again as neighbours.
                at = at[place % 2 == 0]
            gone = after[at]
            ids[at] = r
            alive[gone] = False
            rank[gone] = NEVER
            nxt = after[gone]
            after[at] = nxt
            has = nxt < n
            before[nxt[has]] = at[has]
            rank[at] = NEVER
            rank[at[has]] = self.pair_ranks(ids[at[has]], ids[nxt[has]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.pair_ranks(ids[left], ids[after[left]])
            enter(np.concatenate([at[has], left]))
        keep = np.flatnonzero(alive[:n])
        flat, cuts = ids[keep].tolist(), np.searchsorted(keep, begin).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Numbers(dict):
    """Gives every new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


#: The splitting pattern for texts of ASCII and Latin-1 letters only, where its classes are these; the standard
#: engine is twice as fast on it. Other texts, and other patterns, take the pattern itself.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+"
GENERAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NOT_LATIN = re.compile(rf"[^\t-\r\x20-\x7e{LATIN}]")


class WordCodes:
    """Words of a worker with their ids, the ids as decimal text, and the decoded bytes."""

    def __init__(self, merges: MergeTable, pattern: str):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.find_latin = re.compile(LATIN_PATTERN).findall if pattern == GENERAL_PATTERN else self.find
        self.clear()

    def clear(self) -> None:
        self.at = _Numbers()
        self.decimal: list[bytes] = []
        self.plain: list[bytes] = []
        self.count = np.zeros(0, dtype=np.int64)

    def learn(self) -> None:
        new = list(itertools.islice(self.at, len(self.decimal), None))
        for lo in range(0, len(new), LEARN_WORDS):
            ids = self.merges.encode([w.encode("utf-8", "surrogatepass") for w in new[lo : lo + LEARN_WORDS]])
            self.decimal += [",".join(map(str, x)).encode() for x in ids]
            self.plain += [self.merges.decode(x) for x in ids]
            self.count = np.concatenate([self.count, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))])

    def ids(self, words: np.ndarray) -> list[int]:
        return list(map(int, b",".join(map(self.decimal.__getitem__, words.tolist())).split(b","))) if len(words) else []

    def split(self, text: str) -> np.ndarray:
        found = self.find(text) if NOT_LATIN.search(text) else self.find_latin(text)
        return np.fromiter(map(self.at.__getitem__, found), dtype=np.int32, count=len(found))

    def batches(self, texts: pa.Array, chars: int = 24_000_000):
        """Yields for runs of rows the word numbers of each, once their ids are known."""
        if len(self.at) > CACHE_WORDS:
            self.clear()
        rows, total = [], 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            rows.append(self.split(text))
            total += len(text)
            if total >= chars:
                self.learn()
                yield rows
                rows, total = [], 0
                if len(self.at) > CACHE_WORDS:
                    self.clear()
        self.learn()
        yield rows


_CODES: dict[tuple, WordCodes] = {}


def _shared_ranks(spark: SparkSession, path: str):
    """Broadcast of the ranks and a digest that names them in the workers."""
    ranks = load_ranks(path)
    return spark.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks))


def _codes(shared, pattern: str) -> WordCodes:
    """One set of words for each worker and vocabulary, kept from task to task."""
    name, ranks = shared.value
    key = (name, pattern)
    if key not in _CODES:
        _CODES.clear()
        _CODES[key] = WordCodes(MergeTable(ranks), pattern)
    return _CODES[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids array<int>`` of every row."""
    shared = _shared_ranks(docs.sparkSession, ranks_path)

    def run(batches):
        for batch in batches:
            codes, done = _codes(shared, pattern), 0
            for rows in codes.batches(batch.column(1)):
                ids = [codes.ids(words) for words in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(rows)), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])
                done += len(rows)

    return docs.select(F.col(key), text_or_empty(text).alias("text")).mapInArrow(run, f"{docs.select(key)._jdf.schema().toDDL()}, ids array<int>")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded bytes; ids are not sent to the JVM."""
    shared = _shared_ranks(docs.sparkSession, ranks_path)

    def run(batches):
        for batch in batches:
            codes, done = _codes(shared, pattern), 0
            for rows in codes.batches(batch.column(1)):
                n, ids, plain = [], [], []
                for words in rows:
                    n.append(int(codes.count[words].sum()))
                    listed = words.tolist()
                    ids.append(hashlib.sha256(b",".join(map(codes.decimal.__getitem__, listed))).hexdigest())
                    sha = hashlib.sha256()
                    sha.update(b"".join(map(codes.plain.__getitem__, listed)))
                    plain.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(rows)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digest_documents(documents(spark, sf_dir), ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
