"""Cutting documents into chunks, and the heading path of each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# fixed value: what counts as a heading line
HEADING = r"^(#{1,6})\s+(.+?)$"
PARTS = "doc_id long, section int, text string, heading string, heading_ancestry string"


def pack(text, limit: int):
    """Column: paragraphs packed greedily; a paragraph opens a new chunk if it would make the present one longer than ``limit``.

    The two characters that join paragraphs do not count, and a single paragraph
    over the limit stays whole. Text within the limit is one chunk as it stands.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, para):
        fits = F.length(acc["now"]) + F.length(para) <= limit
        joined = F.when(acc["now"] == "", para).otherwise(F.concat(acc["now"], F.lit("\n\n"), para))
        closed = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, joined).otherwise(para).alias("now"))

    folded = F.aggregate(F.split(text, r"\n\n+"), start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.length(text) <= limit, F.array(text)).otherwise(folded)


def with_overlap(parts: DataFrame, limit: int) -> DataFrame:
    """Chunks that repeat the last max(50, limit // 7) characters of the one before them in their section, from a word's start on."""
    n = max(50, limit // 7)
    w = Window.partitionBy("doc_id", "section").orderBy("part")
    tail = F.expr(f"right(lag(text) over (partition by doc_id, section order by part), {n})")
    tail = F.when(F.length(tail) < n, tail).otherwise(F.regexp_replace(tail, r"(?s)^\S*\s+(?=\S)", ""))
    return parts.withColumn("text", F.when(F.row_number().over(w) > 1, F.concat(tail, F.lit("\n"), F.col("text"))).otherwise(F.col("text")))


def chunk_plain(documents: DataFrame, limit: int = 2000, least: int = 50, overlap: bool = False) -> DataFrame:
    """(doc_id, chunk_index, text, heading, heading_ancestry): packed paragraphs of at least ``least`` characters."""
    parts = documents.where("text is not null").select("doc_id", F.lit(0).alias("section"), F.posexplode(F.filter(F.transform(pack(F.col("text"), limit), strip), lambda t: F.length(t) >= least)).alias("part", "text"))
    parts = with_overlap(parts, limit) if overlap else parts
    return parts.select("doc_id", F.col("part").alias("chunk_index"), "text", F.lit(None).cast("string").alias("heading"), F.lit("").alias("heading_ancestry"))


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, section, text, heading, heading_ancestry): one row per heading and its lines, section 0 before the first.

    Section 0 is there whenever a line stands before the first heading. The path
    of a heading names the nearest lower level before it, that one's, and so on.
    Each text is cut where it lies, so nothing is shuffled.
    """
    heading = re.compile(HEADING)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0)
            at: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                path: dict[int, str] = {}
                number, name, first, lines = 0, None, 0, text.split("\n")
                for k, line in enumerate([*lines, None]):
                    m = heading.match(line) if line is not None else None
                    if m is None and line is not None:
                        continue
                    if k > first or number:  # what stands before the first heading may be nothing
                        out.append((number, "\n".join(lines[first:k]).strip(), name, " > ".join(path[x] for x in sorted(path))))
                        at.append(i)
                    if m:
                        level, name = len(m[1]), m[2].strip()
                        path = {x: y for x, y in path.items() if x < level} | {level: name}
                        number, first = number + 1, k
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "section", "text", "heading", "heading_ancestry"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.where("text is not null").select("doc_id", F.col("text").cast("string")).mapInArrow(cut, PARTS.replace("long", kind, 1))


def chunk_markdown(documents: DataFrame, limit: int = 2000, least: int = 50, overlap: bool = False) -> DataFrame:
    """(doc_id, chunk_index, text, heading, heading_ancestry): sections, packed where they exceed ``limit``, short ones dropped."""
    parts = sections(documents).select("doc_id", "section", "heading", "heading_ancestry", F.posexplode(pack(F.col("text"), limit)).alias("part", "text"))
    parts = parts.where(F.length(strip(F.col("text"))) >= least)
    parts = with_overlap(parts, limit) if overlap else parts
    w = Window.partitionBy("doc_id").orderBy("section", "part")
    return parts.select("doc_id", (F.row_number().over(w) - 1).alias("chunk_index"), "text", "heading", "heading_ancestry")


def frontmatter_tags(text):
    """Column: tags of a leading ``---`` block, inline or as a list, unquoted; case stays; none gives an empty array."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    inline = F.regexp_extract(block, r"(?m)^tags:[ \t]*\[(.*?)\]", 1)
    listed = F.regexp_extract(block, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|\z))+)", 1)
    items = F.when(inline != "", F.split(inline, ",")).when(listed != "", F.regexp_extract_all(listed, F.lit(r"-[ \t]+(.*)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda t: F.regexp_replace(F.trim(t), r"""^["']|["']$""", "")), lambda t: t != "")
