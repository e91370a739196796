"""Rows that share an id, with equal and with different texts, and columns with clashing names."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    base = some(rng, 60)
    texts = [(0, base), (1, base + " x"), (2, some(rng, 50)), (2, some(rng, 55)), (2, some(rng, 55)), (3, base), (3, base), (4, None), (4, ""), (5, "zz " + some(rng, 30)), (5, base + " y"), (None, base), (None, some(rng, 30)), (6, None)]
    return [(i, t, "en", "s", len(t or "")) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(c) for c in ("starts", "copy", "rep", "n", "label", "region", "least", "term", "word", "_ll_row", "hashes")})


def test_jaccard(docs, rows):
    from logloom.llm import jaccard

    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.linked_documents(docs).collect()), key=str)
    # The least text stands for an id: of 5 that is the near copy ("w.." before "zz").
    want = {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 0, None: None, 6: 6}
    assert got == sorted(((r[0], want[r[0]]) for r in rows), key=str)
    # Rows go by id and text: of 3 both rows go, of 5 the one that is linked, and the other text of 2 and 5 stays.
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == sorted(((i, t) for i, t, *_ in rows if i not in (1, 3) and (i != 5 or t.startswith("zz"))), key=str)


def test_other_texts_of_an_id_stay(spark):
    """Of two texts with one id the near copy goes, and the other one stays."""
    from logloom.llm import jaccard

    rng = random.Random(4)
    base = some(rng, 60)
    rows = [(1, base), (2, base + " x"), (2, "zz " + some(rng, 40)), (2, base + " x")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone_id", F.lit(2))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[0], rows[2]])


def test_repeats(docs, rows):
    from logloom.llm import repeats

    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.without_repeats(docs).where("doc_id is not null").collect())
    n = lambda t: len((t or "").split())
    want = [(i, n(t), n(t) if i == 3 else 60 if i in (1, 5) and t.startswith(rows[0][1]) else 0) for i, t, *_ in rows if i is not None]
    assert got == sorted(want)
    alone = repeats.without_repeats(docs).where("doc_id is null").collect()
    assert sorted(r["n_removed"] for r in alone) == [0, 0]


def test_packing(docs, rows):
    from logloom.llm.packing import packed

    got = packed(docs, buckets=3, budget=100).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len((t or "").split())) for i, t, *_ in rows)
    assert len({(r["batch_id"], r["place"]) for r in got}) == len(rows)


def test_pii(docs, rows):
    from logloom.llm import pii

    more = docs.sparkSession.createDataFrame([(2, "mail a@b.cd now", "", "", 0), (2, "other words", "", "", 0), (None, "1.2.3.4", "", "", 0)], DOCS)
    clean = pii.sanitise(more)
    assert sorted((str(r["doc_id"]), r["text"]) for r in clean.collect()) == [("2", "mail [EMAIL] now"), ("2", "other words"), ("None", "[IP]")]
    assert pii.sanitise(docs).columns == docs.columns and pii.spans_with_terms(docs).count() == len(rows)


def test_quality(docs):
    from logloom.llm import quality

    spark = docs.sparkSession
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.good_documents(docs, labels)
    assert out.columns == docs.columns and out.count() <= docs.count()
    scores = quality.scored(docs, quality.fit(docs, labels), ("doc_id", "text")).collect()
    by_text = {}
    for r in scores:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"] and 0 <= r["score"] <= 1


def test_bpe(docs, rows):
    import public_tokenizers

    from logloom.llm import bpe

    got = bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)


def test_chat(spark):
    from logloom.llm import chat

    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first"), (None, 1, "assistant", "x"), (None, 0, None, None)], "conv_id long, turn long, role string, text string").withColumns({"example": F.lit(1), "parts": F.lit("x"), "kind": F.lit("y")})
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand_examples(turns)).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in got.items()} == {1: (3, 5), None: (2, 1)}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"assistant\nfirst\nuser\na\nuser\na\n").hexdigest()


def test_fingerprints(docs, rows):
    from logloom.llm import fingerprints as fp

    got = fp.compared_with_next(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t or "")) for i, t, *_ in rows)
