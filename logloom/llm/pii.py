"""Personal data: base patterns and terms that disclose them.

Base spans are found per kind by the fixed patterns below. The method then looks
at the words around protected values: over the whole corpus it counts how often
a term occurs at all and how often within ``WINDOW`` words of a protected value.
The pointwise mutual information of term and value, divided by the information
content of the value, is the share of the value's information that the term gives
away (1: it occurs only beside that value). A term discloses a value if that share
is at least ``DISCLOSURE``, if it stands beside the value at ``REPEATS`` different
places, and if so many meetings are not expected by chance (fewer than one such
pair among all that were seen, by the Chernoff bound). The same share is taken
with a whole kind of values, for terms such as ``mailto`` that stand beside at
least ``SUPPORT`` different values of it. Disclosing terms are removed wherever
they occur, also far from the value and in documents without one; the values
themselves are generalised to the name of their kind.

Offsets are code points, ends exclusive. Nulls: a null text is empty. Repeated
rows keep their rows. Places are told apart by the text of the document and the
words beside the value, so exact copies of a document, and lines that a document
repeats with all that is around them, count once as evidence; near copies do not.
Values are compared without case (``email``) or separators (``card``, ``phone``).
An empty table gives an empty result. Other columns are ignored or, in
:func:`sanitise`, kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import documents, stored, text_or_empty

WINDOW = 3
REPEATS = 2
SUPPORT = 20
DISCLOSURE = 0.8
#: So many terms may go to every executor; more are joined by a shuffle.
BROADCAST_TERMS = 200_000

# The kinds in the order that spans with equal starts are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TRIMMED = ".,;:!?()[]{}\"'"
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str):
    """An ``@`` never stands in a local part, so a match's local part is the run right before its ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, kind number, end)`` of all kinds, in the order of the digest."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(g.lstrip('0')) <= 3 and int(g.lstrip('0') or '0') <= 255 for g in m.groups())]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k] if k < len(KINDS) else 'term'}:{a}:{b}" for a, k, b in spans)


def words_of(text: str, spans):
    """``(start, end)`` of all words, and for each span the numbers of its first and last word."""
    words = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    starts = [w[0] for w in words]
    return words, [(bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1) for a, _, b in spans]


def same_value(kind: int, value: str) -> str:
    return value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value)


def nearby_terms(text: str, spans) -> list[tuple[str, str, str, int]]:
    """``(term, kind, value, place)`` for the words within ``WINDOW`` of a protected value that touch none."""
    words, reach = words_of(text, spans)
    touched = {i for lo, hi in reach for i in range(lo, hi + 1)}
    document = hashlib.blake2b(text.encode(), digest_size=8)
    out = {}
    for (a, k, b), (lo, hi) in zip(spans, reach, strict=True):
        beside = [*range(max(0, lo - WINDOW), lo), *range(hi + 1, min(len(words), hi + 1 + WINDOW))]
        place = document.copy()
        place.update("\n".join(text[slice(*words[i])] for i in beside).encode())
        place = int.from_bytes(place.digest(), signed=True)
        value = same_value(k, text[a:b])
        for i in beside:
            term = text[slice(*words[i])].lower().strip(TRIMMED)
            if term and i not in touched:
                out.setdefault((i, k, value), (term, KINDS[k], value, place))
    return list(out.values())


def beside_values(docs: DataFrame) -> DataFrame:
    """One row for each word beside a protected value: narrow, no shuffle."""
    names, types = ["term", "kind", "value", "place"], [pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = [r for text in batch.column(0).to_pylist() if (spans := base_spans(text)) for r in nearby_terms(text, spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "term string, kind string, value string, place long")


def trimmed_words(*columns: str) -> list:
    words = F.explode(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    return [*columns, words.alias("word")]


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often each wanted term occurs in the whole corpus; words are summed in each task before they move."""
    trimmed = docs.select(*trimmed_words()).select(F.btrim("word", F.lit(TRIMMED)).alias("term")).where("term != ''")
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return trimmed.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("total"))
    return trimmed.groupBy("term").agg(F.count("*").alias("total")).join(wanted, "term", "left_semi")


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``term, kind, value, disclosure`` of the terms that give a value, or where ``value`` is null its kind, away."""
    # A place is counted once a term however many copies hold it; all sums start in the map tasks.
    by_place = beside_values(docs).groupBy("kind", "value", "term", "place").agg(F.count("*").alias("n"))
    by_value = stored(by_place.groupBy("kind", "value", "term").agg(F.sum("n").alias("n"), F.count("*").alias("support")), "beside")
    pairs = by_value.where(F.col("support") >= REPEATS).join(by_value.groupBy("kind", "value").agg(F.sum("n").alias("n_beside")), ["kind", "value"])
    by_kind = by_value.groupBy("kind", "term").agg(F.sum("n").alias("n"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    kinds = by_kind.join(F.broadcast(by_value.groupBy("kind").agg(F.sum("n").alias("n_beside"))), "kind").withColumn("value", F.lit(None).cast("string"))
    often = stored(pairs.unionByName(kinds), "often")
    n_words = F.coalesce(F.sum(F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))
    words, seen = docs.select(n_words).first()[0], by_value.count()
    totals = term_counts(docs, often.select("term").distinct())
    # A term that the two lower cases spell differently has no total; it occurs as often as it was seen at least.
    total = F.greatest(F.coalesce("total", "n"), F.col("n"))
    share = F.col("n_beside") / F.lit(float(max(words, 1)))
    expected = total * share
    by_chance = F.col("n") * F.log(F.col("n") / expected) - F.col("n") + expected
    disclosure = F.log(F.col("n") / expected) / -F.log(share)
    told = often.join(totals, "term", "left").select("term", "kind", "value", disclosure.alias("disclosure"), by_chance.alias("by_chance"))
    return told.where((F.col("disclosure") >= DISCLOSURE) & (F.col("value").isNull() | (F.col("by_chance") >= math.log(max(seen, 1))))).drop("by_chance")


def term_spans(text: str, spans, terms) -> list[tuple[int, int, int]]:
    """Spans of the words that are one of ``terms``, in the form of :func:`base_spans`; words of protected values are not listed."""
    if not terms or terms.isdisjoint([w.strip(TRIMMED) for w in WORDS.findall(text.lower())]):
        return []
    words, reach = words_of(text, spans)
    touched = {i for lo, hi in reach for i in range(lo, hi + 1)}
    return [(a, len(KINDS), b) for i, (a, b) in enumerate(words) if i not in touched and text[a:b].lower().strip(TRIMMED) in terms]


def terms_of_rows(docs: DataFrame) -> tuple[DataFrame, frozenset | None]:
    """``docs`` and all disclosing terms; where these are too many, None and the terms of each row as ``_ll_terms``."""
    terms = stored(disclosing_terms(docs).select("term").distinct(), "terms")
    known = terms.limit(BROADCAST_TERMS + 1).collect()
    none = F.lit(None).cast("array<string>")
    if len(known) <= BROADCAST_TERMS:
        return docs.withColumn("_ll_terms", none), frozenset(r[0] for r in known)
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("_ll_row")
    words = docs.select(row, "text").select(*trimmed_words("_ll_row")).select("_ll_row", F.btrim("word", F.lit(TRIMMED)).alias("term")).distinct()
    hits = stored(words.join(terms.hint("merge"), "term", "left_semi").groupBy("_ll_row").agg(F.collect_list("term").alias("_ll_terms")), "hits")
    return docs.select("*", row).join(hits.hint("merge"), "_ll_row", "left").drop("_ll_row"), None


_SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def spans_with_terms(docs: DataFrame) -> DataFrame:
    """The base columns and ``spans``: base spans and ``term`` spans, by start."""
    rows, known = terms_of_rows(docs)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            counts, digests, all_spans = [[], [], [], []], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(spelled(spans).encode()).hexdigest())
                all_spans.append(spelled(sorted(spans + term_spans(text, spans, frozenset(own or ()) if known is None else known))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], names)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), "_ll_terms").mapInArrow(run, _SPANS)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_with_terms(documents(spark, sf_dir))


def masked(text: str, spans: str) -> str:
    """Values generalised to ``[KIND]``, disclosing terms removed; of overlapping spans the union is replaced once."""
    if not spans:
        return text
    out, done = [], 0
    marks = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",")))
    for a, negative_end, kind in marks:
        b = -negative_end
        if b <= done:
            continue
        if a >= done:
            out.append(text[done:a])
            if kind != "term":
                out.append(f"[{kind.upper()}]")
        done = b
    out.append(text[done:])
    return "".join(out)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with protected values generalised and disclosing terms removed; columns as before."""
    rows, known = terms_of_rows(docs)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            clean = []
            for text, own in zip(table["text"].to_pylist(), table["_ll_terms"].to_pylist(), strict=True):
                spans = base_spans(text) if text else []
                more = term_spans(text, spans, frozenset(own or ()) if known is None else known) if text else []
                clean.append(masked(text, spelled(spans + more)))
            i = table.schema.get_field_index("text")
            table = table.set_column(i, "text", pa.array(clean, pa.string())).drop_columns(["_ll_terms"])
            if "n_chars" in table.column_names:
                i = table.schema.get_field_index("n_chars")
                n = pa.array([None if t is None else len(t) for t in clean], pa.int64())
                table = table.set_column(i, "n_chars", n)
            yield from table.to_batches()

    return rows.select(*docs.columns, "_ll_terms").mapInArrow(run, schema)
