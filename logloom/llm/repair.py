"""Structure of conversations: faults, and the cheapest edits that mend it.

A conversation is sound if the initials of its roles spell ``(s?(ua)+)?``. Its rows
are taken by turn (nulls first; equal turns by role, then text). Windows flag
each row's first fault: *blank*, *duplicate* (role and text seen earlier) or *truncated*
(no end mark at the end). Then the sorted turns of a conversation are folded by
``aggregate()``. It carries one ``(cost, audit, script)`` for each place in the pattern,
empty, after ``s``, after ``u`` and after ``a``, and takes the ``least`` of every way into
it. Cost and letters depend on each other row by row, so two scripts of one cost differ
before one ends, and the least of a place is always part of the least of the whole.

Edits: ``K`` keep, 0; ``R`` give the role user or assistant, 1; ``D`` delete, 2 (blank
and duplicate rows must go); ``I`` insert an empty text of user or assistant, 5. A
truncated row that stays adds 5. Of edits of one cost the audit that is least in ASCII wins.

Only DataFrame functions are used, and rows move once, by ``conv_id``. Turns are folded
in runs of ``RUN`` rows, each from every place, and the runs' results are joined,
so that long conversations do not copy a long audit at every turn. The digest of a
conversation is one hash of all its text, so one conversation must fit a row.

Nulls: a null role or text is one blank, as is a null id or turn where damage is
drawn; a null turn sorts first. Rows without a ``conv_id`` are one conversation. A
conversation without rows has zeros, an empty audit and the digest of the empty string. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.shared import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
RUN = 256
_NEVER = 1 << 50

# Places in the pattern, and the letters of a script: an audit tells neither which role a row got nor which one came in.
PLACES = ("none", "s", "u", "a")
TO_USER, TO_ASSISTANT, NEW_USER, NEW_ASSISTANT = "R", "S", "I", "J"


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the drawn damage; of each dropped row a marker stays (``gone``)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(F.col("kind") == 0))).alias("gone")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)


def flagged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blank``, ``duplicate``, ``truncated`` (the first fault only) and ``illegal`` (of the pair that the row ends)."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")) > 1
    before = F.lag(F.substring("role", 1, 1)).over(Window.partitionBy("conv_id", "gone").orderBy(*order))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    pair = F.concat("_before", F.substring("role", 1, 1))
    return (
        rows.repartition("conv_id").withColumns({"_before": before, "_again": again, "_last": last})
        .withColumns({"blank": F.col("_last") == "", "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})
        .withColumn("duplicate", ~F.col("blank") & F.col("_again"))
        .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.col("_last").isin(".", "!", "?"))
        .drop("_before", "_again", "_last")
    )


def _way(cost: Column, audit: Column, script: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), script.alias("script"))


def _start(place: str) -> Column:
    return F.struct(*[_way(F.lit(0 if p == place else _NEVER), F.lit(""), F.lit("")).alias(p) for p in PLACES])


def _edited(way: Column, cost, letter: str, script: str | None = None) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letter)), F.concat(way["script"], F.lit(script or letter)))


def _least(*ways: Column) -> Column:
    return F.least(*ways) if len(ways) > 1 else ways[0]


def _inserted(at: Column) -> Column:
    """The least ways after any insertions; two in a row lead everywhere, and more only cost."""
    user = _least(at["u"], *[_edited(at[p], INSERT, "I", NEW_USER) for p in ("none", "s", "a")])
    ways = {"none": at["none"], "s": at["s"], "u": user, "a": _least(at["a"], _edited(user, INSERT, "I", NEW_ASSISTANT))}
    return F.struct(*[w.alias(p) for p, w in ways.items()])


def _turned(at: Column, t: Column) -> Column:
    """The least ways after one row."""
    initial = F.substring(t["role"], 1, 1)
    must_go = t["blank"] | t["duplicate"]
    stays = F.when(must_go, F.lit(_NEVER)).otherwise(F.when(t["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0)))
    kept = lambda way, role: _edited(way, stays + F.when(initial == role, F.lit(KEEP)).otherwise(F.lit(_NEVER)), "K")
    gone = {p: _edited(at[p], DELETE, "D") for p in PLACES}
    to_user = [w for p in ("none", "s", "a") for w in (kept(at[p], "u"), _edited(at[p], stays + REROLE, "R", TO_USER))]
    ways = {
        "none": gone["none"],
        "s": _least(gone["s"], kept(at["none"], "s")),
        "u": _least(gone["u"], *to_user),
        "a": _least(gone["a"], kept(at["u"], "a"), _edited(at["u"], stays + REROLE, "R", TO_ASSISTANT)),
    }
    return F.struct(*[F.struct(F.least(w["cost"], F.lit(_NEVER)).alias("cost"), w["audit"].alias("audit"), w["script"].alias("script")).alias(p) for p, w in ways.items()])


def _folded(turns: Column, place: str) -> Column:
    """The least ways through ``turns`` from one place; insertions come before a row."""
    return F.aggregate(turns, _start(place), lambda at, t: F.transform(F.array(_inserted(at)), lambda w: _turned(w, t))[0])


def _then(at: Column, ways: Column) -> Column:
    """Ways to each place, followed by a run's ways from each place."""

    def into(p: str) -> Column:
        return _least(*[_way(F.least(at[q]["cost"] + ways[q][p]["cost"], F.lit(_NEVER)), F.concat(at[q]["audit"], ways[q][p]["audit"]), F.concat(at[q]["script"], ways[q][p]["script"])) for q in PLACES])

    return F.struct(*[into(p).alias(p) for p in PLACES])


def cheapest(turns: Column) -> Column:
    """``struct(cost, audit, script)`` of the cheapest edits of an array of sorted, flagged turns."""
    later = F.transform(F.sequence(F.lit(1), F.ceil(F.size(turns) / RUN).cast("int") - 1), lambda r: F.slice(turns, r * RUN + 1, F.lit(RUN)))
    later = F.when(F.size(turns) > RUN, later).otherwise(F.slice(F.array(turns), 1, 0))
    follow = lambda at, run: F.transform(F.array(F.struct(*[_folded(run, p).alias(p) for p in PLACES])), lambda ways: _then(at, ways))[0]
    whole = F.aggregate(later, _folded(F.slice(turns, 1, RUN), "none"), follow)
    return F.transform(F.array(F.transform(F.array(whole), _inserted)[0]), lambda w: F.least(w["none"], w["a"]))[0]


def mended(turns: Column, script: Column) -> Column:
    """The turns, ``struct(role, text)``, that a script makes of sorted turns."""
    piece = F.regexp_extract_all(script, F.lit(f"[{NEW_USER}{NEW_ASSISTANT}]*[KD{TO_USER}{TO_ASSISTANT}]"), F.lit(0))
    said = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    new = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: said(F.when(c == NEW_USER, "user").otherwise("assistant"), F.lit("")))

    def of(t: Column, p: Column) -> Column:
        letter = F.right(p, F.lit(1))
        own = said(F.when(letter == TO_USER, "user").when(letter == TO_ASSISTANT, "assistant").otherwise(t["role"]), t["text"])
        none = F.filter(F.array(own), lambda _: F.lit(False))
        return F.concat(new(F.substring(p, F.lit(1), F.length(p) - 1)), F.when(letter == "D", none).otherwise(F.array(own)))

    return F.concat(F.flatten(F.zip_with(turns, piece, of)), new(F.regexp_extract(script, f"[{NEW_USER}{NEW_ASSISTANT}]*$", 0)))


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns`` for every ``conv_id`` of ``rows``.

    ``rows`` is ``conv_id, turn, role, text, gone`` as made by :func:`damaged`; ``turns`` are the mended ones.
    """
    turn = F.struct("turn", "role", "text", "duplicate", "blank", "truncated", "illegal")
    gathered = flagged(rows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(~F.col("gone"), turn))).alias("turns"))
    numbers = F.filter("turns.turn", lambda n: n.isNotNull())
    gaps = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))
    count = lambda flag: F.size(F.filter(F.col(f"turns.{flag}"), lambda f: f)).cast("long").alias(flag)
    made = gathered.withColumn("best", cheapest(F.col("turns")))
    return made.select("conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[count(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), mended(F.col("turns"), F.col("best.script")).alias("turns"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repaired(damaged(table(spark, sf_dir, "conversations")))
    lines = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return made.select(*[c for c in made.columns if c != "turns"], F.sha2(lines, 256).alias("repaired_sha256"))


def _more(way: str, cost: str, letter: str) -> str:
    """A way in SQL is its cost in twelve digits and its audit."""
    return f"lpad(CAST(least(CAST(left({way}, 12) AS BIGINT) + {cost}, 900000000000) AS VARCHAR), 12, '0') || substr({way}, 13) || '{letter}'"


_INSERTED = f"SELECT *, least(a, {_more('u1', '5', 'I')}) AS a1 FROM (SELECT *, least(u, {_more('e', '5', 'I')}, {_more('s', '5', 'I')}, {_more('a', '5', 'I')}) AS u1 FROM {{0}})"
_NOT = "900000000000"


def _kept(way: str, role: str) -> str:
    return _more(way, f"stays + CASE WHEN left(role, 1) = '{role}' THEN 0 ELSE {_NOT} END", "K")


OP13_SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
m AS (SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM m),
o AS (SELECT *, row_number() OVER w AS k, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS ends FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN ends = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN ends NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, before || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
g AS (SELECT *, CASE fault WHEN 'b' THEN {_NOT} WHEN 'd' THEN {_NOT} WHEN 't' THEN 5 ELSE 0 END AS stays FROM f),
r AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, '000000000000' AS e, '{_NOT}' AS s, '{_NOT}' AS u, '{_NOT}' AS a FROM conversations
  UNION ALL
  SELECT conv_id, k, {_more("e", "2", "D")}, least({_more("s", "2", "D")}, {_kept("e", "s")}),
    least({_more("u1", "2", "D")}, {", ".join(w for p in ("e", "s", "a1") for w in (_kept(p, "u"), _more(p, "stays + 1", "R")))}),
    least({_more("a1", "2", "D")}, {_kept("u1", "a")}, {_more("u1", "stays + 1", "R")})
  FROM ({_INSERTED.format("(SELECT r.conv_id, g.k, g.role, g.stays, e, s, u, a FROM r JOIN g ON g.conv_id = r.conv_id AND g.k = r.k + 1)")})),
b AS (SELECT conv_id, least(e, a1) AS best FROM ({_INSERTED.format("(SELECT * FROM r QUALIFY k = max(k) OVER (PARTITION BY conv_id))")})),
l AS (SELECT conv_id, i, substr(best, 12 + i, 1) AS letter FROM (SELECT *, unnest(range(1, length(best) - 11)) AS i FROM b)),
p AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS k, count(*) FILTER (letter <> 'D') OVER w AS place, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
t AS (SELECT p.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS lines
  FROM p LEFT JOIN g ON g.conv_id = p.conv_id AND g.k = p.k WHERE letter <> 'D' GROUP BY p.conv_id),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM g GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(best, 12) AS BIGINT) AS cost, substr(best, 13) AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id = b.conv_id LEFT JOIN t ON t.conv_id = b.conv_id
"""
