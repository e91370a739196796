"""Conversation repair against a search that goes through the rows from their end."""

import hashlib
import random
import sys
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from logloom.llm import repair

sys.setrecursionlimit(10_000)
TURNS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\v\f\r"


def damaged(rows):
    out = {}
    for c, t, role, text in rows:
        kept = out.setdefault(c, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        kept.extend([(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(rows, faults):
    """The least ``(cost, audit, turns)``; the state is the last role of the output."""

    @cache
    def rest(i, last, room):
        """The least way from row ``i`` on, with at most ``room`` insertions before the next row."""
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if i < len(rows):
            for cost, letter, then, said in moves(faults[i], *rows[i][1:], last):
                w = rest(i + 1, then, ROOM)
                ways += [(cost + w[0], letter + w[1], said + w[2])] if w else []
        for name in ("user", "assistant") if room else ():
            if (last, name[0]) in FOLLOWS and (w := rest(i, name[0], room - 1)):
                ways.append((5 + w[0], "I" + w[1], ((name, ""), *w[2])))
        return min(ways) if ways else None

    return rest(0, "", ROOM)


ROOM = 4
FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def moves(fault, role, text, last):
    yield 2, "D", last, ()
    if fault in ("blank", "duplicate"):
        return
    more = 5 * (fault == "truncated")
    if (last, role[:1]) in FOLLOWS:
        yield more, "K", role[:1], ((role, text),)
    for name in ("user", "assistant"):
        if (last, name[0]) in FOLLOWS:
            yield more + 1, "R", name[0], ((name, text),)


def brute(rows):
    out = []
    for c, kept in damaged(rows).items():
        faults, seen = [], set()
        for _, role, text in kept:
            faults.append("blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.strip(BLANK)[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, said = cheapest(kept, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    texts = ["Yes.", "No!", "cut", " ", "", "Why?", "a. b", "Ende.\n", "日本。", "ok.", "fine!", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    out = []
    for c in range(300):
        out += [(c, t if rng.random() > 0.1 else rng.choice([None, 1, t]), rng.choice(roles[: 2 + c % 7]), rng.choice(texts) if c % 4 else f"{rng.randrange(99)}.") for t in range(rng.randrange(1, 9))]
    out += [(None, t, "user", "Hm.") for t in range(4)]
    out += [(400, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(600)]
    out += [(401, 0, "user", "long " * 200_000 + "."), (401, 1, "assistant", "ok.")]
    out += [(c, 0, "user", "Alone.") for c in range(1000, 1060)]
    return out


def result(spark, rows):
    found = repair.repaired(repair.damaged(spark.createDataFrame(rows, TURNS).repartition(3).withColumns({c: F.lit(1) for c in ("gone", "blank", "best", "turns", "_before")})))
    lines = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return sorted((tuple(r) for r in found.withColumn("d", F.sha2(lines, 256)).drop("turns").collect()), key=str)


def test_against_search(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_short_runs(spark, rows, monkeypatch):
    """Runs of three rows, joined, give what one fold gives."""
    monkeypatch.setattr(repair, "RUN", 3)
    few = [r for r in rows if r[0] is None or r[0] < 150]
    assert result(spark, few) == brute(few)


def test_all_dropped_and_empty(spark, rows):
    dropped = [r for r in rows if zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0][:1]
    assert dropped
    assert result(spark, dropped) == [(dropped[0][0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert result(spark, []) == []


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((tuple(r) for r in repair.op13_structure_repair(spark, str(tmp_path)).collect()), key=str) == brute(rows)
