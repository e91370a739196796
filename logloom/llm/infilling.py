"""Fill-in-middle transformation: prefix, suffix and middle of texts in another order.

Each Arrow batch of texts is cut as a whole, over its UTF-8 buffer: a table gives the
class of every byte, a mask over adjacent bytes says where a unit begins, a cumulative
sum of the mask, which starts again at every document, numbers the units, and
one ``searchsorted`` finds the cuts of all rows. A unit is a code point, or a word
with the blanks behind it, or a line with its end; a document always begins one.

What is cut is drawn from the id: ``h1`` to ``h4`` are the first four 8-digit groups of
the SHA-256 of ``1:`` and the decimal id. The prefix ends after the smaller of
``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger. A text stays
``plain`` if it is empty or holds a marker, or by ``h3``; the others are written suffix
first (``spm``) or prefix first (``psm``), by ``h4``. As no cut text holds a marker, an
output holds three, which say where its parts are: :func:`restored` joins them again.

Nulls: a null text is empty and so ``plain``; a null id is drawn from as the empty
string. Repeated rows and ids keep their rows and are cut alike. An empty table gives
an empty result. A text is cut whole, however long it is. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import documents, text_or_empty
from logloom.llm.wordhash import text_chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

# Classes of bytes.
LETTER, BLANK, LINE_END, WITHIN = range(4)
CLASS = np.full(256, LETTER, dtype=np.uint8)
CLASS[[9, 11, 12, 13, 32]] = BLANK
CLASS[10] = LINE_END
CLASS[0x80:0xC0] = WITHIN

CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def begins(data: np.ndarray, offsets: np.ndarray, unit: str = "char") -> np.ndarray:
    """Whether a unit begins at each byte; documents are ``data[offsets[i] : offsets[i + 1]]``."""
    c = CLASS[data]
    if unit == "char":
        mask = c != WITHIN
    else:
        before = np.concatenate([c[:1], c[:-1]])
        mask = before == LINE_END if unit == "line" else (c == LETTER) & ((before == BLANK) | (before == LINE_END))
    mask[offsets[:-1][np.diff(offsets) > 0]] = True
    return mask


def units_upto(mask: np.ndarray) -> np.ndarray:
    """Units that begin before each byte of the buffer, and in all of it."""
    run = np.zeros(len(mask) + 1, dtype=np.int32 if len(mask) < 2**31 else np.int64)
    np.cumsum(mask, out=run[1:], dtype=run.dtype)
    return run


def cut_places(run: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The byte at which unit ``wanted[i]`` (from 0) of document ``i`` begins, or its end; sums start again at every document."""
    base = run[offsets[:-1]]
    at = np.searchsorted(run, (base + wanted + 1).astype(run.dtype), side="left") - 1
    return np.where(wanted < run[offsets[1:]] - base, at, offsets[1:])


def holds_marker(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document holds a marker: adjacent bytes, none of them in another document."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    places = markers(data)
    row = np.searchsorted(offsets, places, side="right") - 1
    inside = places + 3 <= offsets[row + 1]
    out[row[inside]] = True
    return out


def markers(data: np.ndarray) -> np.ndarray:
    """Places of the three markers."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    named = (data[1:-1] == PREFIX[1]) | (data[1:-1] == SUFFIX[1]) | (data[1:-1] == MIDDLE[1])
    return np.flatnonzero((data[:-2] == 60) & named & (data[2:] == 62))


def _texts(pieces: list[list[bytes]]) -> pa.Array:
    """One text for each list of pieces, from one buffer."""
    sizes = np.fromiter((sum(map(len, p)) for p in pieces), dtype=np.int64, count=len(pieces))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(offsets), pa.py_buffer(b"".join([b for p in pieces for b in p])))


def _cut(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str) -> list:
    """Columns of :data:`CUT` but the id; ``draws`` are ``h1 .. h4`` of each row."""
    run = units_upto(begins(data, offsets, unit))
    n = (run[offsets[1:]] - run[offsets[:-1]]).astype(np.int64)
    low, high = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1).T
    plain = (n == 0) | holds_marker(data, offsets) | (draws[:, 2] % 100 >= PLAIN_FROM)
    spm = ~plain & (draws[:, 3] % 100 < SPM_BELOW)
    first, second = cut_places(run, offsets, low), cut_places(run, offsets, high)
    whole = memoryview(np.ascontiguousarray(data))
    pieces = []
    for a, b, c, d, as_is, suffix_first in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
        if as_is:
            pieces.append([whole[a:d]])
        elif suffix_first:
            pieces.append([SUFFIX, whole[c:d], PREFIX, whole[a:b], MIDDLE, whole[b:c]])
        else:
            pieces.append([PREFIX, whole[a:b], SUFFIX, whole[c:d], MIDDLE, whole[b:c]])
    chars, prefix, upto = n, low, high
    if unit != "char":
        run = units_upto(begins(data, offsets))
        base = run[offsets[:-1]].astype(np.int64)
        chars, prefix, upto = run[offsets[1:]] - base, run[first] - base, run[second] - base
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    return [pa.array(chars), form, pa.array(prefix, mask=plain), pa.array(upto - prefix, mask=plain), _texts(pieces)]


def _local(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def transformed(docs: DataFrame, unit: str = "char") -> DataFrame:
    """:data:`CUT` for every row of ``docs``; needs no shuffle. ``n``, ``prefix_chars`` and ``middle_chars`` are code points (null if plain)."""
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unknown unit {unit!r}")
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches):
        for batch in batches:
            draws = np.stack([batch.column(2 + i).to_numpy() for i in range(4)], axis=1)
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                columns = _cut(*_local(data, offsets), draws[lo:hi], unit)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns[:4], columns[4].cast(pa.string())], [f.split()[0] for f in CUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *draws).mapInArrow(run, CUT)


def _restore(data: np.ndarray, offsets: np.ndarray, forms: list[str]) -> pa.Array:
    """Texts of outputs, from the places of their three markers."""
    whole = memoryview(np.ascontiguousarray(data))
    places = markers(data)
    upto = np.searchsorted(places, offsets)
    pieces = []
    for i, form in enumerate(forms):
        a, d = int(offsets[i]), int(offsets[i + 1])
        if form == "plain":
            pieces.append([whole[a:d]])
            continue
        x, y, z = (int(p) for p in places[upto[i] : upto[i + 1]])
        first, second, middle = whole[x + 3 : y], whole[y + 3 : z], whole[z + 3 : d]
        pieces.append([first, middle, second] if form == "psm" else [second, middle, first])
    return _texts(pieces)


def restored(cut: DataFrame) -> DataFrame:
    """``cut`` with ``restored``, the text rebuilt from ``form`` and ``output`` alone."""
    names = cut.columns
    kind, output = names.index("form"), names.index("output")

    def run(batches):
        for batch in batches:
            forms = batch.column(kind).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(output)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, _restore(*_local(data, offsets), forms[lo:hi]).cast(pa.string())], [*names, "restored"])

    return cut.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", restored string")


def _digest(c: str) -> Column:
    return F.sha2(c, 256).alias(f"{c}_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = restored(transformed(documents(spark, sf_dir)))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _digest("output"), _digest("restored"))


_DRAW = "CAST(CAST('0x' || substr(h, {0}, 8) AS UBIGINT) AS BIGINT)"

OP12_SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, {_DRAW.format(1)} % (n + 1) AS x, {_DRAW.format(9)} % (n + 1) AS y, {_DRAW.format(17)} % 100 AS z, {_DRAW.format(25)} % 100 AS v FROM h),
p AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR z >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
q AS (SELECT *, left(text, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM q
"""
