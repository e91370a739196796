"""Line dedup against a plain evaluation of its rules, and its hard rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from logloom.llm import line_templates as lt

DOCS = "doc_id long, text string"
LONG = str.maketrans("0123456789", "abcdefghij")


def token(t):
    return "<*>" if any("0" <= c <= "9" for c in t) else t


def plainly(rows):
    """``{(doc, text): dropped line numbers}`` by the rules of the module, with loops."""
    lines = []
    for doc, text in dict.fromkeys(rows):
        for pos, raw in enumerate((text or "").split("\n") if text is not None else []):
            words = re.findall(r"[^\x20\x09-\x0D]+", raw)
            if words:
                parts = [token(w) for w in words]
                fixed = sum(p != "<*>" for p in parts)
                slight = len(parts) < lt.MIN_TOKENS or fixed < lt.MIN_TOKENS - 1 or 2 * fixed < len(parts)
                lines.append(((doc, text), pos, words if slight and fixed < 2 else parts, slight))
    groups = defaultdict(list)  # template: lines
    leaves, slights = defaultdict(list), defaultdict(set)
    for row, pos, parts, slight in lines:
        if slight:
            slights[tuple(parts)].add(row[0])
            groups["slight", tuple(parts)].append((row, pos))
        else:
            groups["exact", tuple(parts)].append((row, pos))
            leaves[len(parts), tuple(parts[: lt.LEAD])].append((row, pos, parts))
    for (size, lead), own in leaves.items():
        if len({(tuple(p), r[0]) for r, _, p in own}) < lt.MIN_DOCS or len({tuple(p) for *_, p in own}) < 2:
            continue
        counts = [Counter(p[i] for *_, p in own) for i in range(size)]
        for row, pos, parts in own:
            often = tuple((i, parts[i]) for i in range(lt.LEAD, size) if counts[i][parts[i]] >= lt.MIN_DOCS)
            steady = sum(counts[i][parts[i]] >= max(lt.STEADY * len(own), lt.STEADY * lt.MIN_DOCS) for i in range(lt.LEAD, size))
            enough = lambda n: n + lt.LEAD >= lt.ALIKE * size and 2 * n >= size - lt.LEAD  # noqa: E731, B023
            if enough(len(often)):
                groups["sign", size, lead, often].append((row, pos))
            if enough(steady):
                groups["steady", size, lead].append((row, pos))
    n_lines, tokens = Counter(), Counter()
    for parts, docs in slights.items():
        n_lines[len(parts)] += len(docs)
        for t in parts:
            tokens[len(parts), t] += len(docs)
    drops = defaultdict(set)
    for key, members in groups.items():
        docs = {row[0] for row, _ in members}
        if len(docs) < lt.MIN_DOCS:
            continue
        if key[0] == "slight":
            parts = key[1]
            expected = n_lines[len(parts)] * math.prod(tokens[len(parts), t] / (n_lines[len(parts)] * len(parts)) for t in parts)
            if len(parts) < 2 or len(docs) < lt.FAR_ABOVE * expected:
                continue
        first = None if None in docs else min(docs)
        for row, pos in members:
            if row[0] != first:
                drops[row].add(pos)
    return drops


def mixed(seed, n=90):
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    rows = []
    for i in range(n):
        lines = [" ".join(letters(3) for _ in range(rng.randrange(1, 9))) for _ in range(4)]
        lines += [f"{rng.choice('ab')} {rng.choice('abc')}" for _ in range(2)]
        # Several templates with variable words in one leaf, each a minority of it.
        lines.append(f"posted by user {letters(4)} {['on the old board', 'in our new hall', 'at a far gate', 'to ' + letters(3) + ' ' + letters(3) + ' ' + letters(3)][i % 4]}")
        lines.append(f"see the whole {letters(3)}")  # equal leading tokens alone do not make lines alike
        if i % 3:
            lines.append(f"  Page {i} of\t12 in this paper ")
        if i % 2:
            lines += ["All rights reserved.", "", " ", f"{i} {i + 1} 7"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(n, None), (n + 1, ""), (n + 2, "\n\n"), (None, "All rights reserved.\nPage 3 of 9 in this paper\nown words are these here"), (None, None)]
    rows += [rows[5], rows[5], (7, "Page 1 of 2 in this paper\nother words"), (n + 3, "\n".join(["All rights reserved.", "x y z"] * 3000))]
    return rows


@pytest.mark.parametrize("seed, rows_sent", [(1, 400_000), (2, 0)])
def test_equals_the_plain_rules(spark, monkeypatch, seed, rows_sent):
    monkeypatch.setattr(lt, "BROADCAST_ROWS", rows_sent)
    rows = mixed(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("doc_id", "text", "1 as pos", "'x' as doc", "'y' as digest", "0L as size")
    want = plainly(rows)
    assert sum(map(len, want.values())) > 200
    clean = lambda r: r[1] if r not in want else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in want[r])
    out = lt.without_boilerplate(docs)
    assert out.columns == docs.columns
    key = lambda r: (r[0] is None, r[0], r[1] is None, r[1])
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)
    assert got == sorted(((r[0], clean(r)) for r in rows), key=key)
    # Minority templates of one leaf go, lines that only share their leading tokens stay.
    text = dict(got)[80] + dict(got)[81]
    assert "old board" not in text and "new hall" not in text and text.count("see the whole") == 2
