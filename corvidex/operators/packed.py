"""Several values packed in one field (problem 3).

Method: dialects by minimum description length. A dialect is a set of
separators, a quote mark and a wrapping (none, brackets, bullets, JSON). Every
field is parsed under each dialect its characters allow; the description length
of a parse is that of the dialect plus that of its values, where a frequent
value costs minus log2 of its share of all values and any other value is
spelled out letter by letter; a value in the code book also bears its part of
being spelled there once. Each field keeps its cheapest parse.

The shares come from all fields, aggregated in the cluster: first with every
parse of a field counted in equal parts, then again from the cheapest parses.
The code book holds the ``BOOK`` most frequent values (long ones by digest), so
what is broadcast does not grow with the table; rarer values are spelled out.

Of a field with up to ``SEARCHED`` kinds of separators every set of kinds is
tried; with more, sets are improved a kind at a time from several starts, until
none gets shorter. No kind is left out of that search.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

BOOK = 65_536
# fixed values: what separates values; a slash, dot or bullet only between blanks
SEPARATORS = {",": r",", ";": r";", "|": r"\|", "\n": r"\r\n|\r|\n", "\t": r"\t", "，": "，", "、": "、", "；": "；", "/": r"(?<=\s)/(?=\s)", "·": r"(?<=\s)·(?=\s)", "•": r"(?<=\s)•(?=\s)"}
SEARCHED = 6
LONG = 200  # values beyond stand in the book by their digest
LITERAL = 8.0  # bits to say that a separator's text is part of a value, though neither quoted nor escaped
_BULLET = re.compile(r"^[ \t]*[-*•–][ \t]+", re.M)
_SPECIAL = set(",;|\n\r\t，、；[]{}\"\\")


@lru_cache(4096)
def _scanner(separators: tuple[str, ...], others: tuple[str, ...], quote: str) -> re.Pattern:
    """Alternatives, in order: a quoted value up to a separator or the end, an escaped character, a separator, another one's text, anything else."""
    sep = "|".join(SEPARATORS[s] for s in separators) or r"(?!)"
    literal = "|".join(SEPARATORS[s] for s in others) or r"(?!)"
    opens = r"(?<![^\s,;|/，、；·•\[])"
    quoted = rf"(?P<q>{opens}{quote}(?:[^{quote}\\]|\\.|{quote}{quote})*{quote}(?=\s*(?:{sep}|\Z)))" if quote else r"(?P<q>(?!))"
    return re.compile(rf"{quoted}|(?P<e>\\[\s\S])|(?P<s>{sep})|(?P<l>{literal})|(?P<c>[\s\S])")


def _split(body: str, separators: tuple[str, ...], others: tuple[str, ...], quote: str) -> tuple[list[str], int]:
    """(values, separators of other kinds that stand unprotected in them)."""
    values, now, quoted, literal = [], [], None, 0
    for m in _scanner(separators, others, quote).finditer(body):
        kind, text = m.lastgroup, m.group()
        if kind == "s":
            values.append(quoted if quoted is not None else "".join(now).strip())
            now, quoted = [], None
        elif kind == "q" and not "".join(now).strip():
            quoted = re.sub(r"\\(.)", r"\1", text[1:-1].replace(quote * 2, quote)).strip()
        elif quoted is None or not text.isspace():
            if quoted is not None:
                now, quoted = [quoted], None
            now.append(text[1] if kind == "e" and not text[1].isalnum() else text)
            literal += kind == "l"
    values.append(quoted if quoted is not None else "".join(now).strip())
    return [v for v in values if v], literal


def parses(field: str, value: Callable[[str], float] | None = None) -> list[tuple[float, list[str]]]:
    """(bits of the dialect, values) of the dialects that the field's characters allow; ``value`` (bits of a value) guides the search among many kinds."""
    text = field.strip("﻿ \t\r\n\v\f\u00a0\u3000")
    if not text:
        return [(0.0, [])]
    bodies = [(0.0, text)]
    if text[0] == "[" and text[-1] == "]":
        bodies.append((1.0, text[1:-1]))
    lines = [x for x in field.splitlines() if x.strip()]
    if lines and all(_BULLET.match(x) for x in lines):
        bodies.append((1.0, "\n".join(_BULLET.sub("", x, count=1) for x in lines)))
    out = []
    if text[0] == "[" and text[-1] == "]":
        try:
            if isinstance(got := json.loads(text), list) and not any(isinstance(x, (list, dict)) for x in got):
                out.append((2.0, [v for v in (str(x).strip() for x in got if x is not None) if v]))
        except ValueError:
            pass
    for bits, body in bodies:
        held = [s for s, p in SEPARATORS.items() if re.search(p, body)]
        for quote in [""] + [q for q in "\"'" if q in body]:

            def parse(some: tuple[str, ...]) -> tuple[float, list[str]]:
                values, literal = _split(body, some, tuple(x for x in held if x not in some), quote)
                return bits + len(some) + (1.0 if quote else 0.0) + LITERAL * literal, values

            out += _sets(held, parse, value)
    return out


def _sets(held: list[str], parse: Callable, value: Callable[[str], float] | None) -> list[tuple[float, list[str]]]:
    """Parses by sets of the kinds held: all of them, or with many kinds the starts and, given ``value``, what they improve to."""
    if len(held) <= SEARCHED:
        return [parse(some) for n in range(len(held) + 1) for some in combinations(held, n)]
    starts = [(), tuple(held), *((s,) for s in held), *(tuple(x for x in held if x != s) for s in held)]
    known = {s: parse(s) for s in starts}
    if value is None:
        return list(known.values())
    cost = {s: bits + sum(map(value, values)) for s, (bits, values) in known.items()}
    for now in sorted(starts, key=cost.__getitem__)[:4]:
        while True:
            near = [tuple(x for x in held if (x in now) != (x == s)) for s in held]
            for s in near:
                if s not in known:
                    known[s] = parse(s)
                    cost[s] = known[s][0] + sum(map(value, known[s][1]))
            best = min(near, key=cost.__getitem__)
            if cost[best] >= cost[now] - 1e-9:
                break
            now = best
    return list(known.values())


def _key(value: str) -> str:
    return value if len(value) <= LONG else "\0" + hashlib.md5(value.encode("utf-8", "surrogatepass")).hexdigest()


class Code:
    """Code lengths of values: a book of frequent ones, letters for the rest."""

    def __init__(self, book: list[tuple[str, float, float]], total: float):
        """book: (key, occurrences, bits spelled out) of the frequent values."""
        self.total = max(total, 1.0) + 1.0
        self.bits = {v: spelled / n - math.log2(n / self.total) for v, n, spelled in book}  # its share of the book, its code

    @staticmethod
    def spelled(v: str) -> float:
        return 12 + sum(14.0 if c in _SPECIAL else 5.0 for c in v)

    def value(self, v: str) -> float:
        return min(self.bits.get(_key(v), math.inf), self.spelled(v))

    def best(self, field: str) -> list[str]:
        found, least = [], math.inf
        for bits, values in parses(field, self.value):
            bits += sum(map(self.value, values))
            if bits < least - 1e-9 or (abs(bits - least) <= 1e-9 and len(values) > len(found)):
                found, least = values, bits
        return found


def _counts(fields: DataFrame, code: Code | None) -> Code:
    """A code from all fields: of each its cheapest parse under ``code``, or without one every parse in equal parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, float] = {}
            spelled: dict[str, float] = {}
            for field, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                options = [code.best(field)] if code else [v for _, v in parses(field)]
                for values in options:
                    for v in values:
                        k = _key(v)
                        tally[k] = tally.get(k, 0.0) + n / len(options)
                        spelled[k] = Code.spelled(v)
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.float64()), pa.array(list(spelled.values()), pa.float64())], names=["value", "n", "bits"])

    tallied = fields.mapInArrow(count, "value string, n double, bits double").groupBy("value").agg(F.sum("n").alias("n"), F.max("bits").alias("bits"))
    tallied = materialize(tallied, "packed-values")
    total = tallied.agg(F.sum("n")).first()[0] or 0.0
    book = tallied.where("n > 1").orderBy(F.desc("n"), "value").limit(BOOK).collect()
    return Code([(r["value"], r["n"], r["bits"]) for r in book], total)


def unpack(df: DataFrame, id_col: str, packed_col: str) -> DataFrame:
    """(id_col, pos, tag): one row per value packed in ``packed_col``, pos from 0.

    Separators, list marks, enclosing brackets or quotes, escapes and blanks
    around a value are dropped; its inside and case stay. Empty values are
    skipped, a value that occurs twice gives two rows. Null and empty fields give
    none; rows repeated whole count once; further columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(packed_col).cast("string").alias("packed")).where("length(trim(packed)) > 0").distinct()
    fields = materialize(spread(rows.groupBy("packed").agg(F.count(F.lit(1)).alias("n"))), "packed-fields")
    code = _counts(fields, _counts(fields, None))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            at, pos, tags = [], [], []
            for i, field in enumerate(batch.column(1).to_pylist()):
                if (values := known.get(field)) is None:
                    if len(known) >= 100_000:
                        known.clear()
                    values = known[field] = code.best(field)
                at += [i] * len(values)
                pos += range(len(values))
                tags += values
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), pa.array(tags, pa.string())], names=["id", "pos", "tag"])

    kind = rows.schema["id"].dataType.simpleString()
    return spread(rows).mapInArrow(emit, f"id {kind}, pos int, tag string").select(F.col("id").alias(id_col), "pos", "tag")
