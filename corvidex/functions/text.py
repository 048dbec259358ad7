"""Text expressions as Columns, and their driver-side counterparts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
# as unicode61 has it: small Latin letters with one mark become the bare letter, others keep theirs; marks that stand by themselves go
MARKS = "".join(map(chr, (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331)))
ACCENTED = "".join(c for c in map(chr, range(0x80, 0x2000)) if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and d[0].isalpha())
BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def strip(c: Column) -> Column:
    """All Unicode white space off both ends (trim() takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses ``/``, case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "^"))
            end = pattern.find("]", j + (pattern[j : j + 1] == "]"))
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
                out.append("[" + ("^" + body[1:] if body[:1] == "!" else "\\" + body if body[:1] == "^" else body) + "]")
                i = end + 1
        else:
            out.append(re.escape(c) if c.isascii() else c)
    return "(?s)^" + "".join(out) + r"\z"


def folded(text: str) -> str:
    """Lower-cased, without the diacritics that unicode61 removes."""
    return text.lower().translate(str.maketrans(ACCENTED, BARE, MARKS))


def tokens(c: Column, fold: bool = True) -> Column:
    """Lower-cased maximal runs of letters and digits, diacritics removed if ``fold``; null gives none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_extract_all(F.translate(low, ACCENTED + MARKS, BARE) if fold else low, F.lit(TOKEN), F.lit(0))


def last_parts(path: Column, n: int = 2) -> Column:
    """The last n components of a path, the whole path if it has no more."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= n, path).otherwise(F.array_join(F.slice(parts, -n, n), "/"))


def format_size(size: Column) -> Column:
    """Decimal megabytes, kilobytes or bytes with one decimal; null stays null."""
    return (
        F.when(size >= 1_000_000, F.concat(F.round(size / 1_000_000, 1).cast("string"), F.lit(" MB")))
        .when(size >= 1_000, F.concat(F.round(size / 1_000, 1).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def embedding_text(text: Column, ancestry: Column, path: Column) -> Column:
    """What is embedded for a chunk: its path, its heading path if any, a blank line, its text."""
    head = F.when(F.coalesce(ancestry, F.lit("")) != "", F.concat(path, F.lit(" > "), ancestry)).otherwise(path)
    return F.concat(head, F.lit("\n\n"), text)


def title(text: Column, path: Column) -> Column:
    """A first-line level-one heading, else the file name without its last suffix."""
    heading = F.regexp_extract(text, r"(?mdU)\A#\s+(.+?)$", 1)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.when(F.coalesce(heading, F.lit("")) != "", strip(heading)).otherwise(stem)


def snippet(text: Column, words: list[str], width: int = 500) -> Column:
    """A window of ``width`` characters around the mean first position of the query's words, with dots where it cuts."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    places = F.filter(F.array(*[F.locate(w.lower(), low) - 1 for w in words] or [F.lit(-1)]), lambda p: p >= 0)
    centre = F.when(F.size(places) > 0, F.floor(F.aggregate(places, F.lit(0), lambda a, p: a + p) / F.size(places))).otherwise(F.lit(0)).cast("int")
    start = F.greatest(F.lit(0), F.least(centre - width // 2, F.length(text) - width)).cast("int")
    body = text.substr(start + 1, F.lit(width))
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(start + width < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when(F.length(text) <= width, text).otherwise(cut)


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\|", r"\\|"), r"\n", " ")
