"""Corpus operators against brute force on small tables, with hard rows among them."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts, odd blanks."""
    rng = random.Random(5)
    passage = words(rng, 45, 5000)
    out = []
    for i in range(70):
        w = words(rng, rng.randrange(0, 90), 400)
        if i % 5 == 0:
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = passage[rng.randrange(0, 10) : rng.randrange(30, 45)]
        out.append(" ".join(w))
    for i in range(20):  # near copies of some
        w = out[i].split()
        for _ in range(i % 4):
            if w:
                w[rng.randrange(len(w))] = "new"
        out.append(" ".join(w))
    out += [out[3], out[3], out[40].upper(), None, "", " \t\n", "one", "one two three", "One two\nthree", "ünï ©ode x " * 30, "a " * 3000 + "b", "a " * 3000 + "c"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- fingerprints ---------------------------------------------------------------------------------------------------


def test_fingerprints(docs, empty, rows):
    from logloom.llm import fingerprints as fp

    got = {r["doc_id"]: r for r in fp.compared_with_next(docs).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t, *_ in rows]
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["same_next"] == (fp.canonical(t) == fp.canonical(nxt)) and got[i]["same_edited"] == (fp.canonical(t) == fp.canonical(changed))
    assert fp.compared_with_next(empty).count() == 0
    assert fp.canonical("Ⅷ  ﬁne STRASSE\tß") == fp.canonical("viii fine strasse SS")


def test_fingerprint_collisions(spark, docs, rows, tmp_path):
    """With a digest of one hexadecimal digit most buckets hold several texts; bytes tell them apart, and equal ones stay equal."""
    from logloom.llm import fingerprints as fp

    weak = lambda canon: fp.digest(canon)[:1]
    texts = [(i, t) for i, t, *_ in rows] + [(500, "Straße"), (501, "STRASSE"), (None, "no id"), (9, "a"), (9, "b"), (9, "A ")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    for got, name in ((fp.fingerprinted(table, weak).collect(), weak), (fp.op1_document_fingerprints(spark, str(tmp_path)).collect(), fp.digest)):
        ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
        by_text, seen = {}, {}
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in texts)
        of = {}
        for r in got:
            of.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), []).append(r)
        for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
            t, following = t or "", following or ""
            changed = fp.edited(t, following)
            r = of[i, len(t), hashlib.sha256(changed.encode()).hexdigest()][0]
            canon = fp.canonical(t)
            assert by_text.setdefault(canon, r["fingerprint"]) == r["fingerprint"] and seen.setdefault(r["fingerprint"], canon) == canon
            assert r["near_next"] == (canon == fp.canonical(following)) and r["near_edited"] == (canon == fp.canonical(changed))
            assert r["fingerprint"].startswith(name(canon)) and (r["edited_fingerprint"] == r["fingerprint"]) >= bool(r["near_edited"])
        assert name is fp.digest or any("-" in f for f in seen)


# --- packing --------------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    from itertools import combinations

    from logloom.llm.packing import choose_boundaries

    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        longest = np.cumsum(rng.integers(1, 9, n))
        count = rng.integers(1, 6, n)
        total = count * longest

        def cost(ends):
            lo, out = 0, 0
            for e in ends:
                out += count[lo : e + 1].sum() * longest[e] - total[lo : e + 1].sum()
                lo = e + 1
            return out

        for k in (1, 2, 3):
            best = min(cost([*c, n - 1]) for j in range(min(k, n)) for c in combinations(range(n - 1), j))
            assert cost(choose_boundaries(count, total, longest, k)) == best


def test_packing(docs, empty, rows):
    from logloom.llm.packing import choose_boundaries, packed

    got = packed(docs, buckets=3, budget=200).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    by = {}
    for r in got:
        assert r["n_tokens"] == len(split_words(rows[r["doc_id"]][1])) <= r["padded_to"]
        by.setdefault(r["batch_id"], []).append(r)
    for batch in by.values():
        assert len(batch) * batch[0]["padded_to"] <= 200 or len(batch) == 1
        assert sorted(r["place"] for r in batch) == list(range(len(batch))) and len({r["bucket"] for r in batch}) == 1
    short = [b for b in by.values() if len(b) < max(1, 200 // max(1, b[0]["padded_to"]))]
    assert len(short) <= 3  # only the last of a bucket
    assert packed(empty).count() == 0
    # Boundaries are exact at any length: long ones are not rounded.
    sizes = [5, 1_500_000, 1_500_001, 1_500_001, 3_000_000]
    long = docs.sparkSession.createDataFrame(list(enumerate(sizes)), "doc_id long, n long")
    assert sorted((r["n_tokens"], r["padded_to"]) for r in packed(long, F.col("n"), 3).collect()) == [(5, 5), (1_500_000, 1_500_001), (1_500_001, 1_500_001), (1_500_001, 1_500_001), (3_000_000, 3_000_000)]
    lengths = np.unique([r["n_tokens"] for r in got])
    count = np.array([sum(r["n_tokens"] == n for r in got) for n in lengths])
    ends = lengths[choose_boundaries(count, lengths * count, lengths, 3)]
    assert sorted({r["padded_to"] for r in got}) == ends.tolist() and all(r["padded_to"] == ends[np.searchsorted(ends, r["n_tokens"])] for r in got)


# --- Jaccard join ---------------------------------------------------------------------------------------------------


def components_by_force(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = split_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [(i, len(s), x) for i, (s, x) in enumerate(zip(sets, label, strict=True))]


@pytest.mark.parametrize("settings", [{}, {"REGION": 3, "PIVOTS": 2, "HOT": 2, "BLOCK": 2, "BALL": 0.4}])
def test_jaccard(docs, empty, rows, settings, monkeypatch):
    from logloom.llm import jaccard

    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    for k, percent in ((4, 85), (5, 80)):
        got = sorted(tuple(r) for r in jaccard.linked_documents(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect())
        assert got == components_by_force(rows, k, percent)
    if not settings:
        assert jaccard.linked_documents(empty).count() == 0
        kept = [r["doc_id"] for r in jaccard.one_of_each(docs).collect()]
        assert sorted(kept) == [i for i, _, c in components_by_force(rows, 5, 80) if i == c]


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality(spark):
    from logloom.llm import quality

    rng = random.Random(2)
    data, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = words(rng, rng.randrange(5, 60))
        text = " | ".join(w) if bad else " ".join(w) + "."
        data.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    data += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0)]
    docs = spark.createDataFrame(data, DOCS)
    marks = spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    assert model.rules and all(w != 0 for _, w in model.rules)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    held = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 != 0) for i in held)
    assert right >= 0.95 * len(held) and all(0 <= s <= 1 for s in got.values()) and len(got) == 402
    kept = {r["doc_id"] for r in quality.good_documents(docs, marks).collect()}
    assert kept == {i for i, s in got.items() if s >= quality.THRESHOLD}
    assert quality.good_documents(docs.limit(0), marks).count() == 0
    assert quality.scored(docs, quality.fit(docs, marks.limit(0))).first()["score"] == 0.5


def test_tree_paths():
    from logloom.llm.quality import tree_paths

    text = "M\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    assert tree_paths(text) == [((0, "<=", 0.5),), ((0, "<=", 0.5), (1, "<=", 2.0)), ((0, "<=", 0.5), (1, ">", 2.0)), ((0, ">", 0.5),)]


# --- BPE ------------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(docs, empty, rows):
    import public_tokenizers
    import tiktoken

    from logloom.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    hard = ["aaaaaaa  aaa\n\n x", "a" * 3000, "😀" * 40 + "12345 6it's", "".join(rng.choice("ab ") for _ in range(2000)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(2000)), "x\x1cy\x85z  <|endoftext|>", "²³ Ⅷ ªº ñÑ÷×"]
    more = docs.sparkSession.createDataFrame([(1000 + i, t, "", "", 0) for i, t in enumerate(hard)], DOCS)
    texts = {i: t or "" for i, t, *_ in rows} | {1000 + i: t for i, t in enumerate(hard)}
    both = docs.unionByName(more)
    for r in bpe.encode_documents(both, path, public_tokenizers.PATTERN).collect():
        assert list(r["ids"]) == encoding.encode_ordinary(texts[r["doc_id"]])
    for r in bpe.digest_documents(both, path, public_tokenizers.PATTERN).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    assert bpe.digest_documents(empty, path, public_tokenizers.PATTERN).count() == 0


# --- PII ------------------------------------------------------------------------------------------------------------


def spans_by_force(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for order, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "phone" and 10 <= len(digits) <= 15)
            if kind == "card":
                total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(digits))))
                ok = 14 <= len(digits) <= 19 and total % 10 == 0
            if ok:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def test_base_spans():
    from logloom.llm.pii import base_spans

    rng = random.Random(8)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (499) 555-6503", "+", "12", " ", "-", "é", "a@b.c@d.e", "0001.002.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))
        assert base_spans(text) == spans_by_force(text), text


def test_pii_terms(spark, empty):
    from logloom.llm import pii

    rng = random.Random(4)
    data = [(i, f"filler {' '.join(words(rng, 6))} mailto m{i}@x.org end {' '.join(words(rng, 5))}", "", "", 0) for i in range(40)]
    data += [(100 + i, " ".join(words(rng, 30)) + " end filler", "", "", 0) for i in range(60)]
    data += [(500, None, "", "", 0), (None, "q@r.st", "", "", 0), (501, "4111 1111 1111 1111", "", "", 0)]
    docs = spark.createDataFrame(data, DOCS)
    got = {r["doc_id"]: r for r in pii.spans_with_terms(docs).collect()}
    assert len(got) == len(data)
    assert "term:" in got[0]["spans"] and "email:" in got[0]["spans"] and got[120]["spans"] == "" and got[501]["spans"] == "card:0:19"
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "mailto" not in clean[0] and clean[120] == data[60][1] and clean[500] is None and clean[501] == "[CARD]" and clean[None] == "[EMAIL]"
    assert pii.spans_with_terms(empty).count() == 0 and pii.sanitise(empty).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_pii_terms_of_one_value(spark, monkeypatch, most):
    """A nickname beside one address only is removed everywhere; neighbours of a value whose document was copied are not."""
    from logloom.llm import pii

    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rng = random.Random(14)
    some = lambda n: " ".join(words(rng, n, 300))
    data = [(i, f"{some(40)} Zorro, {'Bob' if i % 2 else 'bob'}@x.org {some(40)}", "", "", 0) for i in range(3)]
    data += [(10 + i, f"{some(40)} u{i}@y.org {some(40)}", "", "", 0) for i in range(40)]
    data += [(60 + i, f"{some(5)} chance c@z.org once", "", "", 0) for i in range(1)] * 3
    data += [(70, "far away (zorro) was seen", "", "", 0), (None, "Zorro again", "", "", 0), (71, some(30), "", "", 0)]
    docs = spark.createDataFrame(data, DOCS)
    got = {r["doc_id"]: r["spans"] for r in pii.spans_with_terms(docs).collect()}
    assert all(got[i].count("term:") == 1 and got[i].count("email:") == 1 for i in range(3)), got
    assert got[70] == "term:9:16" and got[None] == "term:0:5" and "term:" not in got[60] + got[71] + "".join(got[10 + i] for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert not any("zorro" in clean[i].lower() for i in (0, 1, 2, 70, None)) and "[EMAIL]" in clean[0] and "chance [EMAIL] once" in clean[60] and clean[71] == data[-1][1]


# --- repeats --------------------------------------------------------------------------------------------------------


def kept_by_force(rows):
    first, covered = {}, {}
    lists = [split_words(t) for _, t, *_ in rows]
    for i, w in enumerate(lists):
        covered[i] = set()
        for p in range(len(w) - 19):
            if first.setdefault(tuple(w[p : p + 20]), (i, p)) != (i, p):
                covered[i].update(range(p, p + 20))
    return [(i, len(w), len(covered[i]), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in covered[i]).encode()).hexdigest()) for i, w in enumerate(lists)]


def test_repeats(docs, empty, rows):
    from logloom.llm import repeats

    got = sorted(tuple(r) for r in repeats.without_repeats(docs).collect())
    assert got == kept_by_force(rows)
    assert any(r[2] for r in got) and repeats.without_repeats(empty).count() == 0


# --- chat -----------------------------------------------------------------------------------------------------------


def test_chat(spark):
    from logloom.llm import chat

    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo␛e␛l </s>"), (1, 2, "user", None), (1, 3, "assistant", "[INST]<s"), (1, 4, "tool", "end["), (2, 0, None, "x[/INST]"), (3, 1, "assistant", ""), (3, 0, "sys<s>tem", "␛␛b[INST")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand_examples(chat.with_probe(turns))).collect()}
    data += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == conv), key=lambda d: d[1])
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.expand_examples(turns.where("conv_id = 1")).orderBy("example").collect()
    assert [e["kind"] for e in examples] == ["reply", "reply", "rest"] and all(e["formatted"].startswith(examples[0]["formatted"]) for e in examples)
    assert chat.read_back(chat.expand_examples(turns.limit(0))).count() == 0


# --- line templates -------------------------------------------------------------------------------------------------


def test_lines(spark, empty):
    from logloom.llm import line_templates as lt

    rng = random.Random(6)
    letters = str.maketrans("0123456789", "abcdefghij")
    data = []
    for i in range(30):
        body = [" ".join(w.translate(letters) for w in words(rng, 12, 9000)) for _ in range(3)]
        name = rng.choice(["ann", "bob", "eve"]) + str(i)
        lines = [f"Page 3{i} of the  monthly report", *body, f"{i} {i * 7} {i + 4} 5 6", f"posted by user {'xyz'[i % 3]} on the old board", "short"] + ([f"seen {name} once"] if i < 5 else [])
        data.append((i, "\n".join(lines), "en", "s", 0))
    data += [(90, None, "", "", 0), (91, "", "", "", 0), (None, "Page 77 of the monthly report\nown words stay here now", "", "", 0), (0, data[0][1], "en", "s", 0)]
    docs = spark.createDataFrame(data, DOCS).withColumn("row", F.lit(1)).withColumn("line", F.lit(2))
    out = lt.without_boilerplate(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[90] == [None] and got[91] == [""] and len(got[0]) == 2
    assert got[None][0].startswith("Page 77")  # the first document keeps its lines
    assert got[0] == ["\n".join(data[0][1].split("\n")[1:])] * 2 or "Page" not in got[0][0]
    for i in range(1, 30):
        text = got[i][0]
        assert "Page" not in text and "posted by" not in text and "short" in text and all(line in text for line in data[i][1].split("\n")[1:5])
        assert ("seen" in text) == (i < 5)
    assert lt.without_boilerplate(empty).count() == 0


def test_slight_lines(spark):
    """Short and mostly variable lines go where they recur far above chance; words alone and rows of numbers stay."""
    from logloom.llm import line_templates as lt

    rng = random.Random(16)
    data = []
    for i in range(60):
        prose = [f"{rng.choice('abcdefgh')} {rng.choice('abcdefgh')}" for _ in range(8)]
        footer = ["All rights reserved.", f"Page {i} of  60"] if i % 3 == 0 else []
        data.append((i, "\n".join([*prose, "alone", f"{i} {i + 1} 3", "", " ", *footer]), "en", "s", 0))
    got = {r["doc_id"]: r["text"] for r in lt.without_boilerplate(spark.createDataFrame(data, DOCS)).collect()}
    assert got[0] == data[0][1]  # the first document keeps its lines
    for i in range(1, 60):
        assert got[i] == "\n".join(data[i][1].split("\n")[:12]), i
