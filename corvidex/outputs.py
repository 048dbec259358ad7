"""Result rows as text: JSON, CSV, Markdown."""

from __future__ import annotations

import csv
import io
import json

FORMATS = ("json", "csv", "md")
COLUMNS = {
    "search": ("rank", "doc_path", "heading", "similarity", "rrf_score", "sources", "text"),
    "fts": ("rank", "doc_path", "heading", "bm25", "text"),
    "ask": ("rank", "doc_path", "heading"),
    "similar": ("rank", "doc_path", "similarity", "title"),
    "list": ("path", "type", "chunk_count", "size_bytes", "indexed_at"),
}


def take_format(args: list[str]) -> tuple[str | None, list[str]]:
    """(the format asked for, the other arguments): of several flags JSON goes before CSV before Markdown, and only that one is taken out."""
    for name in FORMATS:
        if f"--{name}" in args:
            at = args.index(f"--{name}")
            return name, args[:at] + args[at + 1 :]
    return None, args


def _plain(v) -> str:
    return "" if v is None else "+".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def to_csv(rows: list[dict], columns: tuple[str, ...]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows([_plain(r.get(c)) for c in columns] for r in rows)
    return out.getvalue()


def to_markdown(rows: list[dict], columns: tuple[str, ...]) -> str:
    cell = lambda v: _plain(v).replace("|", "\\|").replace("\n", " ")
    lines = [list(columns), ["---"] * len(columns), *([cell(r.get(c)) for c in columns] for r in rows)]
    return "".join(f"| {' | '.join(x)} |\n" for x in lines)


def write(value: dict, rows: list[dict], kind: str, form: str) -> str:
    return to_json(value) + "\n" if form == "json" else (to_csv if form == "csv" else to_markdown)(rows, COLUMNS[kind])
