"""Line dedup by a tree of line templates.

Every line is parsed at a fixed depth: the tree's first level is the number of
tokens, the next ``LEAD`` levels are the leading tokens, with variable fields
(tokens that hold a digit) generalised to ``<*>``. A path ends in a leaf.

* A *template* is a line with its variable fields generalised.
* Where a leaf is met in at least ``MIN_DOCS`` documents, its lines are compared by
  position. A token is *frequent* at a position if at least ``MIN_DOCS`` lines of the leaf
  hold it there, and *steady* if ``STEADY`` of them do; all else is a variable field. Lines
  with the same frequent tokens share a template, so a leaf has as many as it needs, and
  lines that agree with the steady ones share one, too. At least ``ALIKE`` of all
  positions and half of those behind the leading tokens must be fixed by it.

A template that is found in at least ``MIN_DOCS`` documents recurs: its lines are
dropped everywhere but in the document with the smallest id, so what the corpus
says stays in it once.

*Slight* lines have fewer than ``MIN_TOKENS`` tokens, fewer than ``MIN_TOKENS - 1``
fixed ones, or more variable tokens than fixed ones. They are counted like all
others, but prose repeats them by chance, so they must also be found in
``FAR_ABOVE`` times as many documents as the frequencies of their tokens among
slight lines of so many tokens predict. With fewer than two fixed tokens a slight
line says nothing when generalised and is counted as it stands. A line of one
token is as frequent as its token, so it is never above that and stays.

Counts cover all documents. Recurring templates and the numbers of dropped lines are
sent to the texts where they are few, and joined by a shuffle beyond a stated size; a
hot template is summed up in the map tasks before it moves.

Nulls: a null text stays null and has no lines. A null ``doc_id`` counts as one
document and sorts first. Rows of equal id and text are one document and lose
the same lines. Of rows with one id and different texts the lines of each are counted under
that id. An empty table gives an empty result; other columns are kept by
:func:`without_boilerplate` whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import documents, stored

MIN_TOKENS = 4
MIN_DOCS = 10
FAR_ABOVE = 3
LEAD = 3
STEADY = 0.5
ALIKE = 0.7
#: So many leaves, templates or documents with dropped lines (under 100 bytes each) may go to every executor.
BROADCAST_ROWS = 400_000
#: So many line numbers may go with them.
BROADCAST_LINES = 8_000_000

BLANKS = r"[\x20\x09-\x0D]+"


#: A token with a digit, found from its start in one pass; tokens without one are left at their first digitless run.
WITH_DIGIT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def generalised(line: Column) -> Column:
    """Variable fields, tokens that hold a digit, become ``<*>``; blanks are folded. Plain lines are only looked at."""
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, WITH_DIGIT, "<*>")).otherwise(line)
    odd = reduce(or_, [line.contains(c) for c in ("  ", "\t", "\r", "\x0b", "\x0c")])  # byte searches, far below the cost of a pattern
    return F.btrim(F.when(odd, F.regexp_replace(fields, BLANKS, " ")).otherwise(fields))


def _digest() -> Column:
    return F.xxhash64("text")


def _sent(rows: DataFrame) -> DataFrame:
    """``rows`` (a stored table) for the side of a join that is sent to every executor, or merged where they are many."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows.hint("merge")


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, digest, pos, line, size, slight`` of all lines with a token; ``line`` is generalised."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), _digest().alias("digest"), "text").where("text is not null")
    lines = base.select("doc", "digest", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).where(F.length("raw") > 0)
    # Filters are not moved below a projection that numbers rows, so a line is generalised once.
    plain = lines.select("doc", "digest", "pos", "raw", generalised(F.col("raw")).alias("line"), F.monotonically_increasing_id().alias("at")).where("line != '' and at >= 0").drop("at")
    sized = plain.withColumn("size", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    fixed = F.col("size") - F.when(F.contains(F.col("line"), F.lit("<*>")), F.regexp_count("line", F.lit(r"<\*>"))).otherwise(0)
    flagged = sized.withColumn("fixed", fixed).withColumn("slight", (F.col("size") < MIN_TOKENS) | (F.col("fixed") < MIN_TOKENS - 1) | (2 * F.col("fixed") < F.col("size")))
    as_it_stands = F.btrim(F.regexp_replace("raw", BLANKS, " "))
    return flagged.select("doc", "digest", "pos", F.when(F.col("slight") & (F.col("fixed") < 2), as_it_stands).otherwise(F.col("line")).alias("line"), "size", "slight")


def _documents_of(rows: DataFrame, *key: str) -> DataFrame:
    """``key``, the number of documents with it and the first of them; rows with equal ids count once."""
    each = rows.groupBy(*key, "doc").agg(F.lit(1).alias("one"))
    return each.groupBy(*key).agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"), F.max(F.col("doc").isNull()).alias("null_first"))


def _drops(rows: DataFrame, recurring: DataFrame, *key: str) -> DataFrame:
    """``doc, digest, pos`` of the lines of recurring templates outside their first document."""
    hit = rows.join(_sent(stored(recurring.select(*key, "first", "null_first"), "recurring")), [*key])
    stays = F.when(F.col("null_first"), F.col("doc").isNull()).otherwise(F.coalesce(F.col("doc") == F.col("first"), F.lit(False)))
    return hit.where(~stays).select("doc", "digest", "pos")


def _unexpected(slight: DataFrame) -> DataFrame:
    """The recurring ones of slight lines that are far above what the frequencies of their tokens predict."""
    each = stored(_documents_of(slight, "line", "size"), "slight")
    tokens = each.select("size", "n_docs", F.explode(F.split("line", " ")).alias("token")).groupBy("size", "token").agg(F.sum("n_docs").alias("n"))
    lines = F.broadcast(each.groupBy("size").agg(F.sum("n_docs").alias("n_lines")))  # sizes of slight lines: one row each
    often = each.where(F.col("n_docs") >= MIN_DOCS)
    wanted = often.where("size > 1").select("line", "size", F.explode(F.split("line", " ")).alias("token"))
    share = F.col("n") / (F.col("n_lines") * F.col("size"))
    chance = wanted.join(tokens, ["size", "token"]).join(lines, "size").groupBy("line", "size", "n_lines").agg(F.sum(F.log(share)).alias("log_p"))
    expected = chance.select("line", "size", (F.col("n_lines") * F.exp("log_p")).alias("expected"))
    return often.join(expected, ["line", "size"]).where(F.col("n_docs") >= FAR_ABOVE * F.col("expected")).drop("expected")


def _positional(lines: DataFrame) -> DataFrame:
    """``doc, digest, pos, leaf, sign``: lines with a template by position; ``sign`` is 0 for the steady template of the leaf."""
    each = lines.groupBy("leaf", "template", "doc").agg(F.lit(1).alias("one")).groupBy("leaf", "template").agg(F.count("*").alias("n"))
    # Leaves met in many documents whose lines are not all of one template.
    loose = stored(each.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where((F.col("n") >= MIN_DOCS) & (F.col("kinds") > 1)).select("leaf"), "loose")
    inside = lines.join(_sent(loose), "leaf", "left_semi").select("doc", "digest", "pos", "leaf", "size", F.split("line", " ").alias("tokens"))
    tokens = stored(inside.select("doc", "digest", "pos", "leaf", "size", F.posexplode("tokens").alias("place", "token")).where(F.col("place") >= LEAD).withColumn("token", F.xxhash64("token")), "tokens")
    counts = tokens.groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    full = counts.groupBy("leaf", "place").agg(F.sum("n").alias("all"), F.max(F.struct("n", "token"))["token"].alias("top"))
    kept = counts.where(F.col("n") >= STEADY * MIN_DOCS).join(full, ["leaf", "place"])
    steady = (F.col("token") == F.col("top")) & (F.col("n") >= STEADY * F.col("all"))
    fixed = stored(kept.select("leaf", "place", "token", steady.alias("steady"), (F.col("n") >= MIN_DOCS).alias("frequent")).where("steady or frequent"), "fixed")
    marked = tokens.join(_sent(fixed), ["leaf", "place", "token"])
    # Tokens of a line lie side by side, so a task sums them up to one row before it moves.
    by_line = marked.groupBy("doc", "digest", "pos", "leaf", "size").agg(F.count_if("steady").alias("steady"), F.count_if("frequent").alias("frequent"), F.bit_xor(F.when(F.col("frequent"), F.xxhash64("place", "token"))).alias("sign"))
    enough = lambda n: (n + LEAD >= ALIKE * F.col("size")) & (2 * n >= F.col("size") - LEAD)
    signs = F.array(F.when(enough(F.col("steady")), F.lit(0).cast("long")), F.when(enough(F.col("frequent")), F.col("sign")))
    return by_line.select("doc", "digest", "pos", "leaf", F.explode(signs).alias("sign")).where("sign is not null")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``doc, digest, drops``: the sorted numbers of the lines that go, for each document that loses any."""
    leaf = F.when(~F.col("slight"), F.xxhash64("size", F.substring_index("line", " ", LEAD)))
    every = stored(_lines(docs).select("doc", "digest", "pos", leaf.alias("leaf"), F.xxhash64("line").alias("template"), "line", "size"), "lines")
    lines, slight = every.where("leaf is not null"), every.where("leaf is null").drop("leaf", "template")
    # Lines of one leaf have equal sizes and leading tokens, so a template's hash only tells lines of its leaf apart.
    exact = _documents_of(lines, "leaf", "template").where(F.col("n_docs") >= MIN_DOCS)
    alike = stored(_positional(lines), "alike")
    shared = _documents_of(alike, "leaf", "sign").where(F.col("n_docs") >= MIN_DOCS)
    gone = _drops(lines, exact, "leaf", "template").unionByName(_drops(slight, _unexpected(slight), "line", "size")).unionByName(_drops(alike, shared, "leaf", "sign"))
    return gone.groupBy("doc", "digest").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def _cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_ll_lines`` and ``_ll_drops`` where a document loses lines."""
    drops = stored(dropped_lines(docs), "drops").withColumnsRenamed({"doc": "_ll_doc", "digest": "_ll_digest", "drops": "_ll_drops"})
    rows, lines = drops.agg(F.count("*"), F.coalesce(F.sum(F.size("_ll_drops")), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS and lines <= BROADCAST_LINES
    on = (F.col("doc_id").cast("long").eqNullSafe(F.col("_ll_doc"))) & (_digest() == F.col("_ll_digest"))
    joined = docs.join(F.broadcast(drops) if few else drops.hint("merge"), on, "left")
    return joined.withColumn("_ll_lines", F.when(F.col("_ll_drops").isNotNull(), F.split("text", "\n")))


def _kept_text() -> Column:
    """The runs of lines between dropped ones, each cut out once."""
    n = F.size("_ll_lines")
    before, after = F.concat(F.array(F.lit(-1)), "_ll_drops"), F.concat("_ll_drops", F.array(n))
    runs = F.zip_with(before, after, lambda a, b: F.slice("_ll_lines", a + 2, b - a - 1))
    return F.when(F.col("_ll_drops").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped and ``n_chars``, if there, counted anew."""
    out = _cleaned(docs).withColumn("text", _kept_text())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, lines in all and dropped, and the digest of the text that stays, for every document."""
    rows = _cleaned(documents(spark, sf_dir).select("doc_id", "text"))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_ll_drops"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.coalesce(_kept_text(), F.lit("")), 256).alias("kept_sha256"))
