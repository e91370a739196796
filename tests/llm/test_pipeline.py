"""Every stage of the corpus pipeline takes effect, keeps the columns and handles hard rows."""

import random

import pytest

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        body = " | ".join(prose(rng, 1) for _ in range(40)) if bad else prose(rng, 60).capitalize() + ".\n" + prose(rng, 20) + "."
        rows.append((i, body + "\nThis whole text is under the same licence as ever."))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(300 + i, rows[i][1] + f"\nwrite to u{i}@x.org today please friend {prose(rng, 4)}") for i in (2, 3, 7)]  # near copies of 2, 3, 7
    rows += [(400, None), (401, ""), (None, prose(rng, 60)), (5, rows[5][1]), (402, "word " * 50_000)]
    where = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, docs, rows


def test_stages(spark, corpus):
    where, docs, _ = corpus
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_copies", "pii", "packing"]
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = spark.createDataFrame(out.collect(), DOCS)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i for i in range(240) if i % 4}
    kept = {i for i in seen["quality"] if i is not None and i < 240}
    assert len(good - kept) <= 2 and len(kept - good) <= 2  # clean documents stay
    licence = [i for i, t in seen["lines"].items() if t and "same licence" in t]
    assert len(licence) == 1 and licence[0] == min(i for i in seen["lines"] if i is not None)
    assert not {302, 303, 307} & set(seen["near_copies"]) and {2, 3, 7} <= set(seen["near_copies"]) and set(seen["near_copies"]) >= kept
    assert set(seen["pii"]) == set(seen["near_copies"]) and not any("@x.org" in (t or "") for t in seen["pii"].values())
    last = cp.STAGES[-1][1](spark, docs, where).collect()
    assert {r["doc_id"] for r in last} == set(seen["pii"]) and len(last) == docs.count()
    one = sorted(map(str, cp.run(spark, where).collect()))
    assert one == sorted(map(str, last))


def test_empty_table(spark, corpus):
    where, docs, _ = corpus
    nothing = docs.limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, nothing, where)
        assert out.count() == 0
