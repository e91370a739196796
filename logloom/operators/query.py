"""The predicate language of document tables, compiled to one column.

``{"f": v}`` and operators ``$eq $gt $lt $like $in`` on fields; ``$or`` and
``$and`` as the first key. A malformed query raises ``ValueError`` on the
driver. Whole queries become one :class:`Column`, so nothing is evaluated in
Python and the optimiser sees every condition.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import and_, eq, gt, lt, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import db_trim, is_int_string

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def _text(value) -> str:
    """An operand as text: strings trimmed, other JSON values as written."""
    return (value if isinstance(value, str) else json.dumps(value)).strip(" \t\n\r")


def _integer(text: str) -> bool:
    digits = text[1:] if text[:1] in ("+", "-") else text
    return bool(digits) and digits.isascii() and digits.isdigit()


def _compare(field: Column, operand: str, how: str) -> Column:
    """Integers when both sides are, else text by bytes. Integers beyond 32 bits compare as false."""
    value = db_trim(field)
    against = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}[how]
    as_text = against(value, F.lit(operand))
    if not _integer(operand):
        return as_text
    number = int(operand)
    fits = INT_MIN <= number <= INT_MAX
    as_int = F.coalesce(against(value.try_cast("int"), F.lit(number)), F.lit(False)) if fits else F.lit(False)
    return F.when(is_int_string(value), as_int).otherwise(as_text)


def equality_key(field: Column) -> Column:
    """Equal for values that compare as equal: integers by number, other text as it is; NULL for what equals nothing."""
    value = db_trim(field)
    return F.when(is_int_string(value), value.try_cast("int").cast("string")).otherwise(value)


def _in(field: Column, items: list) -> Column:
    texts = [_text(i) for i in items]
    plain = [t for t in texts if not _integer(t)]
    tests = [_compare(field, t, "=") for t in texts if _integer(t)]
    if plain:
        tests.append(db_trim(field).isin(plain))
    return reduce(or_, tests, F.lit(False))


def _condition(field: Column, value) -> Column:
    if not isinstance(value, Pairs):
        if isinstance(value, list):
            return db_trim(field) == json.dumps(value)
        operand = _text(value)
        return _compare(field, operand, "=") if operand else (F.lit(False) if not isinstance(value, str) else db_trim(field) == "")
    tests = []
    for name, operand in value:
        if name == "$in":
            if not isinstance(operand, list):
                raise ValueError("$in needs a list")
            tests.append(_in(field, operand))
        elif name in ("$eq", "$gt", "$lt", "$like"):
            text = _text(operand)
            if not text:
                continue
            if name == "$like":
                tests.append(db_trim(field).like(text.replace("\\", "\\\\")))
            else:
                tests.append(_compare(field, text, {"$eq": "=", "$gt": ">", "$lt": "<"}[name]))
    return reduce(and_, tests) if tests else F.lit(False)


class Pairs(list):
    """A JSON object as pairs in order, so that repeated keys survive."""


def compile_query(query: str | dict, field=None) -> Column:
    """``query`` as a Boolean column, never NULL. ``field(name)`` gives a document's field; by default ``fields[name]`` and ``_id``."""
    if field is None:
        field = lambda name: F.col("_id") if name == "_id" else F.try_element_at("fields", F.lit(name))
    return _compiled(parsed_query(query), field)


def parsed_query(query: str | dict) -> Pairs:
    text = query if isinstance(query, str) else json.dumps(query)
    try:
        parsed = json.loads(text, object_pairs_hook=Pairs, parse_float=str) if text.strip() else Pairs()
    except json.JSONDecodeError as e:
        raise ValueError(f"malformed query: {e}") from e
    if not isinstance(parsed, Pairs):
        raise ValueError("a query is a JSON object")
    return parsed


def _compiled(query: Pairs, field) -> Column:
    if not query:
        return F.lit(True)
    first, value = query[0]
    if first in ("$or", "$and"):
        if not isinstance(value, list) or isinstance(value, Pairs) or not all(isinstance(q, Pairs) for q in value):
            raise ValueError(f"{first} needs a list of queries")
        parts = [_compiled(q, field) for q in value]
        return reduce(or_ if first == "$or" else and_, parts) if parts else F.lit(False)
    # Combinators in a later place are field names, which no document has.
    return reduce(and_, [F.coalesce(_condition(field(name), v), F.lit(False)) for name, v in query])


def equal_values(query: str | dict, name: str) -> list[str] | None:
    """Values of which ``name`` must equal one in every match, as far as the query's form tells; None where it does not tell."""
    return _equal_values(parsed_query(query), name)


def _both(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    return b if a is None else a if b is None or len(a) <= len(b) else b


def _equal_values(query: Pairs, name: str) -> list[str] | None:
    if not query:
        return None
    first, value = query[0]
    if first in ("$or", "$and"):
        parts = [_equal_values(q, name) for q in value] if isinstance(value, list) and all(isinstance(q, Pairs) for q in value) else [None]
        if first == "$and":
            return reduce(_both, parts, None)
        return None if None in parts else [v for p in parts for v in p]
    return reduce(_both, [_values_of(v) for n, v in query if n == name], None)


def _values_of(value) -> list[str] | None:
    """Of one condition on a field; ``[]`` for one that nothing meets is left to the whole predicate."""
    if not isinstance(value, Pairs):
        return [json.dumps(value) if isinstance(value, list) else _text(value)]
    found = None
    for name, operand in value:
        if name == "$eq" and _text(operand):
            found = _both(found, [_text(operand)])
        elif name == "$in" and isinstance(operand, list):
            found = _both(found, [_text(i) for i in operand])
    return found


#: Below it are exactly the texts that begin with a blank or another sign that is not printed, and the empty text.
PRINTED_FROM = "!"


def implied_filter(query: str | dict, columns: dict[str, Column], prefixes: dict[str, tuple[Column, int]] | None = None) -> Column | None:
    """A weaker condition on plain columns that every match of ``query`` meets, or None where none is found.

    The exact predicate trims values and compares integers, which files cannot be pruned by. This one
    compares ``columns``, the fields as stored, with constants alone, so scans push it down; it must be
    used together with the exact one. ``prefixes`` gives for a field a column that holds its first ``n``
    characters, such as a partition's date.
    """
    return _implied(parsed_query(query), columns, prefixes or {})


def _implied(query: Pairs, columns: dict, prefixes: dict) -> Column | None:
    if not query:
        return None
    first, value = query[0]
    if first in ("$or", "$and"):
        parts = [_implied(q, columns, prefixes) for q in value] if isinstance(value, list) and all(isinstance(q, Pairs) for q in value) else []
        if first == "$or":
            return reduce(or_, parts) if parts and not any(p is None for p in parts) else None
        parts = [p for p in parts if p is not None]
        return reduce(and_, parts) if parts else None
    tests = [t for n, v in query for t in _implied_tests(n, v, columns, prefixes)]
    return reduce(and_, tests) if tests else None


def _implied_tests(name: str, value, columns: dict, prefixes: dict) -> list[Column]:
    """Conditions for one field. A value that begins with a blank passes them all; blanks behind a value only make it greater."""
    if not isinstance(value, Pairs):
        value = Pairs([("$eq", json.dumps(value) if isinstance(value, list) else _text(value))])
    stored_as = [(columns[name], None)] if name in columns else []
    stored_as += [(prefixes[name][0], prefixes[name][1])] if name in prefixes else []
    out = []
    for column, n in stored_as:
        cut = lambda t, n=n: t if n is None else t[:n]
        led = column < PRINTED_FROM
        for how, operand in value:
            if how == "$in" and isinstance(operand, list):
                texts = [_text(i) for i in operand]
                if texts and not any(_integer(t) or not t for t in texts):
                    out.append(reduce(or_, [_between(column, cut(t)) for t in texts]) | led)
                continue
            text = _text(operand) if how in ("$eq", "$gt", "$lt", "$like") else ""
            if not text or (how != "$like" and _integer(text)):
                continue
            if how == "$eq":
                out.append(_between(column, cut(text)) | led)
            elif how == "$gt":
                out.append((column >= cut(text)) | led)
            elif how == "$lt" and min(text) >= " ":
                out.append((column <= cut(text)) | led)
            elif how == "$like":
                begins = re.split("[%_]", text)[0]
                if begins and n is None:
                    out.append(column.startswith(begins) | led)
    return out


def _between(column: Column, text: str) -> Column:
    """Equal to ``text``, or longer by blanks."""
    return (column >= text) & (column < text + PRINTED_FROM)


def matches(query: Pairs, fields: dict[str, str], doc_id: str | None = None) -> bool:
    """The predicate for one document, for queries that are data and so no column; equal to :func:`compile_query`."""
    return predicate(query)(fields, doc_id)


def predicate(query: Pairs) -> Callable[[dict[str, str], str | None], bool]:
    """:func:`matches` of a query that many documents are tried on; operands are read once."""
    if not query:
        return lambda fields, doc_id: True
    first, value = query[0]
    if first in ("$or", "$and"):
        parts, how = [predicate(q) for q in value], any if first == "$or" else all
        return lambda fields, doc_id: bool(parts) and how(p(fields, doc_id) for p in parts)
    tests = [(name, _test(v)) for name, v in query]

    def holds(fields: dict[str, str], doc_id: str | None) -> bool:
        for name, test in tests:
            found = doc_id if name == "_id" else fields.get(name)
            if found is None or not test(found.strip(" \t\n\r")):
                return False
        return True

    return holds


def _test(value) -> Callable[[str], bool]:
    """One condition, for a field's trimmed value."""
    if not isinstance(value, Pairs):
        if isinstance(value, list):
            return json.dumps(value).__eq__
        operand = _text(value)
        return _holding(operand, "=") if operand else lambda own: isinstance(value, str) and own == ""
    tests: list[Callable[[str], bool]] = []
    for name, operand in value:
        if name == "$in":
            tests.append(_any_of([_holding(_text(i), "=") for i in operand]))
        elif name in ("$eq", "$gt", "$lt", "$like") and (text := _text(operand)):
            tests.append(_fits(_like(text)) if name == "$like" else _holding(text, {"$eq": "=", "$gt": ">", "$lt": "<"}[name]))
    return tests[0] if len(tests) == 1 else lambda own: bool(tests) and all(t(own) for t in tests)


def _any_of(tests: list[Callable[[str], bool]]) -> Callable[[str], bool]:
    return lambda own: any(t(own) for t in tests)


def _fits(pattern: re.Pattern) -> Callable[[str], bool]:
    return lambda own: pattern.fullmatch(own) is not None


def _holding(operand: str, how: str) -> Callable[[str], bool]:
    """A comparison with ``operand``. Text compares by code points, which is the order of its UTF-8 bytes."""
    against = {"=": eq, ">": gt, "<": lt}[how]
    if not _integer(operand):
        return lambda own: against(own, operand)
    number = int(operand)
    fits = INT_MIN <= number <= INT_MAX

    def holds(own: str) -> bool:
        if not _integer(own):
            return against(own, operand)
        return fits and INT_MIN <= (n := int(own)) <= INT_MAX and against(n, number)

    return holds


@lru_cache(maxsize=1000)
def _like(pattern: str) -> re.Pattern:
    return re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), re.DOTALL)


def checked(query: Pairs) -> Pairs:
    """``query`` if every part of it is well formed; ``ValueError`` else."""
    if query and query[0][0] in ("$or", "$and"):
        first, value = query[0]
        if not isinstance(value, list) or isinstance(value, Pairs) or not all(isinstance(q, Pairs) for q in value):
            raise ValueError(f"{first} needs a list of queries")
        for q in value:
            checked(q)
    elif any(n == "$in" and not isinstance(o, list) for _, v in query if isinstance(v, Pairs) for n, o in v):
        raise ValueError("$in needs a list")
    return query


def access_keys(query: Pairs) -> list[tuple[str, str | None]]:
    """What a match must hold one of: a field with a value that equals the given one, or where that is None with any; ``("", None)`` is every document."""
    if not query:
        return [("", None)]
    first, value = query[0]
    if first == "$or":
        return list(dict.fromkeys(k for q in value for k in access_keys(q)))
    if first == "$and":
        ways = [access_keys(q) for q in value]
        return min(ways, key=lambda w: (any(v is None for _, v in w), ("", None) in w, len(w))) if ways else []
    for name, v in query:
        values = _values_of(v)
        if values is not None:
            return [(name, t) for t in dict.fromkeys(values)]
    return [(query[0][0], None)]
