"""Compiled rules against a plain evaluation of rules and weights; a disclosure value worked out by hand."""

import math
import random

import pytest

from logloom.llm import pii, quality

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÆÇÈÉÊËÍÎÏÑÓÔÖŒÚÙÛÜ"


def plain_statistics(text):
    n = len(text)
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    share = lambda signs: sum(c in signs for c in text) / n if n else 0.0
    blanks = sum(c in " \n\t\r" for c in text)
    return [
        share(" \n\t\r"), share(UPPER), share("0123456789"), share(".,;:"), share("!?"), share("|#$%&*@^~=<>{}[]\\/_+"), share("\n"), math.log1p(n),
        (n - blanks) / len(words) if words else 0.0, len(set(words)) / len(words) if words else 0.0, math.log1p(len(words)),
    ]


def plain_score(model, stats):
    total = model.intercept
    for rule, weight in model.rules:
        if all(stats[i] <= t if op == "<=" else stats[i] > t for i, op, t in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def texts():
    rng = random.Random(9)
    signs = ["a", "B", "É", "7", ".", "!", "|", " ", "  ", "\n", "\t", "\v", "word ", "日"]
    return [None, "", " ", "x", "A.", *["".join(rng.choice(signs) for _ in range(rng.randrange(1, 80))) for _ in range(150)]]


def test_rules_against_plain_evaluation(spark):
    rng = random.Random(4)
    table = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    stats = [plain_statistics(t or "") for t in texts()]
    rules = []
    for _ in range(60):  # thresholds that some text meets exactly
        rule = tuple((i, rng.choice(["<=", ">"]), rng.choice(stats)[i]) for i in rng.sample(range(len(quality.NAMES)), rng.randrange(1, 4)))
        rules.append((rule, rng.uniform(-2, 2)))
    fitted = quality.fit(table, spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int"))
    for model in (quality.RuleEnsemble(rules, 0.3), quality.RuleEnsemble([], -1.0), fitted):
        got = {r["doc_id"]: r["score"] for r in quality.scored(table, model).collect()}
        assert got == pytest.approx({i: plain_score(model, s) for i, s in enumerate(stats)}, abs=1e-9)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.good_documents(table, labels).collect()}
    assert kept == {i for i, s in enumerate(stats) if plain_score(fitted, s) >= quality.THRESHOLD}


def test_disclosure_by_hand(spark):
    """``zorro`` stands beside one address at two places and nowhere else; ``often`` stands there twice, and eight times elsewhere."""
    other = [f"filler{i} text{i} more{i}" for i in range(300)] + ["often seen"] * 8
    rows = ["p1 often zorro a@b.cd q1 q2 q3 r r r", "s1 s2 Zorro, A@b.cd often t1 t2 u u u", *other]
    found = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    words, beside = sum(len(t.split()) for t in rows), 6 + 6
    share = beside / words
    assert found == pytest.approx({"zorro": math.log(2 / (2 * share)) / -math.log(share)}) and found["zorro"] == pytest.approx(1.0)
    often = math.log(2 / (10 * share)) / -math.log(share)
    assert 0 < often < pii.DISCLOSURE
    spans = {r["doc_id"]: r["spans"] for r in pii.spans_with_terms(spark.createDataFrame([(0, rows[0]), (1, "again ZORRO!"), *[(i, t) for i, t in enumerate(rows[1:], 2)]], "doc_id long, text string")).collect()}
    assert spans[0] == "term:9:14,email:15:21" and spans[1] == "term:6:12"
