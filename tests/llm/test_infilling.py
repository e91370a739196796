"""Fill-in-middle against a plain cut of every text."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import infilling

UNITS = {"char": r"(?s).", "word": r"(?s)(?:\A[ \t\n\v\f\r]+)?[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|\A[ \t\n\v\f\r]+", "line": r"[^\n]*\n|[^\n]+"}


def plain_cut(doc_id, text, unit="char"):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if unit == "word":
        units = re.findall(r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", text)
        lead = re.match(r"[ \t\n\v\f\r]*", text)[0]
        units = [lead, *units] if lead else units
    else:
        units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(text), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(text), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    signs = ["a", "b", " ", "\n", "é", "日", "🦊", "<", ">", "P", "S", "M", "\t", "\r"]
    out = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 60)))) for i in range(600)]
    out += [(9, "twice"), (9, "twice"), (9, "other"), (None, "no id"), (None, None), (700, None), (701, ""), (702, "<P>"), (703, "x<M"), (704, ">y"), (705, "<<<"), (706, "é" * 1_500_000), (707, "\n\n"), (-5, "negative id")]
    return out


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_against_plain_cut(spark, rows, unit):
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3).withColumns({c: F.lit(1) for c in ("n", "form", "output", "restored", "h1")})
    got = infilling.restored(infilling.transformed(docs, unit)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain_cut(i, t, unit) for i, t in rows), key=key)
    assert sorted(hashlib.sha256(r["restored"].encode()).hexdigest() for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_markers_of_two_texts():
    """Bytes of neighbours in the buffer make no marker."""
    data = np.frombuffer(b"ab<P>cd<S>e<M>", dtype=np.uint8)
    assert infilling.holds_marker(data, np.array([0, 3, 7, 7, 9, 14])).tolist() == [False, False, False, False, True]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infilling.restored(infilling.transformed(empty)).count() == 0
    with pytest.raises(ValueError):
        infilling.transformed(empty, "page")


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(str(x) for x in r) for r in infilling.op12_fill_in_middle(spark, str(tmp_path)).collect()))
    assert got == sorted(tuple(str(x) for x in (*plain_cut(i, t)[:5], sha(plain_cut(i, t)[5]), sha(t or ""))) for i, t in rows)
