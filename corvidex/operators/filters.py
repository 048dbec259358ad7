"""Inline query filters: parsed on the driver, applied as Column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex


@dataclass(frozen=True)
class Filters:
    file_glob: str | None = None
    type_glob: str | None = None
    tags: tuple[str, ...] = ()
    date_after: str | None = None
    date_before: str | None = None
    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()

    @property
    def active(self) -> bool:
        return any((self.file_glob, self.type_glob, self.tags, self.date_after, self.date_before, self.must, self.must_not))

    def without_tags(self) -> Filters:
        return replace(self, tags=())


def parse_filters(query: str) -> tuple[str, Filters]:
    """(the query without filters, the filters). Of type:, file: and dt only the first counts; tag:, +"" and -"" repeat."""
    rest = query

    def first(pattern: str) -> str | None:
        nonlocal rest
        m = re.search(pattern, rest)
        if not m:
            return None
        rest = rest[: m.start()] + rest[m.end() :]
        return m.group(1)

    def every(pattern: str) -> tuple[str, ...]:
        nonlocal rest
        found = re.findall(pattern, rest)
        rest = re.sub(pattern, "", rest)
        return tuple(x.lower() for x in found if x)

    type_glob = first(r"type:(\S+)")
    tags = every(r"tag:(\S+)")
    file_glob = first(r"file:(\S+)")
    after, before = first(r'dt>=?"([^"]*)"'), first(r'dt<=?"([^"]*)"')
    must, must_not = every(r'\+"([^"]*)"'), every(r'-"([^"]*)"')
    return re.sub(r"\s+", " ", rest).strip(), Filters(file_glob, type_glob, tags, after, before, must, must_not)


def tag_set(tags: Column) -> Column:
    """Comma-joined tags as a lower-cased, trimmed array without empty ones; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def predicate(f: Filters, path: str = "doc_path", kind: str = "type", tags: str = "tags", at: str = "indexed_at", text: str = "text") -> Column:
    """The conjunction of all active filters; null fields count as empty, so an unknown date passes dt< and fails dt>."""
    empty = F.lit("")
    ok = F.lit(True)
    if f.file_glob:
        ok &= F.coalesce(F.col(path), empty).rlike(glob_to_regex(f.file_glob))
    if f.type_glob:
        ok &= F.coalesce(F.col(kind), empty).rlike(glob_to_regex(f.type_glob))
    if f.tags:
        ok &= F.size(F.array_except(F.array(*[F.lit(t) for t in f.tags]), tag_set(F.col(tags)))) == 0
    if f.date_after:
        ok &= F.coalesce(F.col(at), empty) >= f.date_after
    if f.date_before:
        ok &= F.coalesce(F.col(at), empty) <= f.date_before
    low = F.lower(F.coalesce(F.col(text), empty))
    for word in f.must:
        ok &= F.contains(low, F.lit(word))
    for word in f.must_not:
        ok &= ~F.contains(low, F.lit(word))
    return ok


def tagged_chunks(chunks: DataFrame, documents: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(chunk_id) of the chunks whose document has all tags: to be pushed below retrieval."""
    docs = documents.where(predicate(Filters(tags=tuple(t.lower() for t in tags)))).select("doc_id").distinct()
    return chunks.join(docs, "doc_id", "left_semi").select("chunk_id").distinct()
