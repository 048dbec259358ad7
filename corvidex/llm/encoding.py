"""Garbled text from a wrong character encoding (problem 1).

Method: every swap of code pages is a substitution cipher, under which each
symbol (a character, or a sequence of them) stands for another letter
throughout. A source's words are a mixture of clean words and of words under
such ciphers; expectation-maximization against the bigrams of the languages
takes the mixture apart, per column and source (``documents.source``).

* Ciphers whose symbols are known a priori: pairs of public code pages, READ_AS
  with MEANT_AS, and UTF-16. E: which cipher, if any, is a word under; M: how
  frequent is each cipher in each source (drawn towards the column's figures by
  DRAWN words), and what are the bigrams of the clean text.
* One further cipher per source whose symbols are not known: characters that a
  source uses far more often than the others do are symbols, and what they stand
  for is learned from their neighbours by EM (forward-backward over the bigrams,
  emissions re-estimated each round). A learned cipher is kept if most of its
  words, at least LEAST_WORDS different ones, turn into words seen elsewhere;
  of its symbols, those of which the same holds, from one word on.

Mappings of single characters are applied as translation tables, to whole
batches at once; those of several (UTF-8, East Asian pages) on the word's bytes.

Work is done on distinct words (maximal runs without ASCII white space) of a
column and source that hold a character beyond ASCII; all counts cover all
rows. What reaches the driver is bounded: pairs of character classes,
characters, ciphers of sources that have garbled words, symbols.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WORD = re.compile(r"[^ \t\n\r\f\x0b]*[^\x00-\x7f][^ \t\n\r\f\x0b]*")  # in Java \v would be more than \x0b
# fixed values: the pages through which bytes may have been read, and the ones they may have been meant in
READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "mac_cyrillic", "gbk", "cp932", "big5")
MEANT_AS = ("utf_8", "cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "iso8859_2", "cp932", "euc_jp", "gbk")
SEVERAL = ("utf_8", "gbk", "cp932", "big5", "euc_jp")  # those with several bytes a character
WIDE = ("utf_16_le", "utf_16_be")
DRAWN = 500.0  # words
LEAST_WORDS = 5
LETTERS = 2816
SHARED = 2480  # classes from here on hold several characters


@lru_cache(None)
def _page(name: str) -> dict[str, int] | None:
    """Character to byte of a single-byte page; bytes it leaves undefined read as C1 controls."""
    table: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        if len(c) != 1:
            return None
        table.setdefault(c, b)
    for b in range(128, 160):  # readers that pass undefined bytes through
        table.setdefault(chr(b), b)
    return table


@lru_cache(None)
def _encoder(name: str) -> dict[int, int] | None:
    table = _page(name)
    return None if table is None else {ord(c): b for c, b in table.items()}


def to_bytes(word: str, page: str) -> bytes | None:
    try:
        if page in SEVERAL:
            return word.encode(page)
        return codecs.charmap_encode(word, "strict", _encoder(page))[0]
    except UnicodeEncodeError:
        return None


def _classes() -> np.ndarray:
    """A class below LETTERS for every code point of the first plane: letters of the corpus' scripts apart, other blocks whole."""
    out = np.empty(0x10000, np.uint16)
    n = 0
    single = [(0, 0x250), (0x370, 0x530), (0x2000, 0x2300), (0x2500, 0x25A0), (0x3000, 0x3100), (0xFF00, 0x10000)]
    apart = np.zeros(0x10000, bool)
    for a, b in single:
        out[a:b] = np.arange(n, n + b - a)
        apart[a:b] = True
        n += b - a
    rest = ~apart
    block = np.arange(0x10000) // 256
    block[0x3400:0xA000] = 0x4E  # the ideographs
    names, code = np.unique(block[rest], return_inverse=True)
    out[rest] = n + code
    assert n == SHARED and n + len(names) < LETTERS - 1
    return out


CLASS = _classes()
LOST = "\ufffd"
_BARRED, _ASTRAL = LETTERS - 1, LETTERS - 2
FOLDED = CLASS.astype(np.int32)  # digits are one class, and so are blanks
FOLDED[48:58] = FOLDED[48]
FOLDED[[9, 10, 11, 12, 13]] = FOLDED[32]
FOLDED[0xFFFF] = _ASTRAL


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with a blank around each, where each text starts); those beyond the first plane are one."""
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    c = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(c, 0xFFFF).astype(np.int32), np.cumsum(n) - n + 1


class Bigrams:
    """log P of words from class bigrams and characters within their class, both smoothed."""

    def __init__(self, code: np.ndarray, n: np.ndarray, chars: dict[int, float]):
        order = np.argsort(code)
        code, n = code[order], n[order]
        self.code, self.n, self.chars = code[n > 0], n[n > 0].astype(np.float64), chars
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def made(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log P(b | a) of all classes, log P of each character in its class, counts of a, base of b); made once per worker and round."""
        if self._made is None:
            left, right = (np.bincount(k, self.n, LETTERS) for k in (self.code // LETTERS, self.code % LETTERS))
            base = (right + 0.5) / (self.n.sum() + 1 + 0.5 * LETTERS)
            p = np.empty((LETTERS, LETTERS), np.float32)
            p[:] = 20 * base
            p.ravel()[self.code] += self.n
            p /= (left + 20.0).astype(np.float32)[:, None]
            np.log(p, out=p)
            lost = int(CLASS[ord(LOST)])
            p[lost] = p[0]
            p[:, lost] = -5
            p[:, _BARRED] = p[_BARRED] = -1e6
            code = np.fromiter(self.chars, np.int64, len(self.chars))
            n = np.fromiter(self.chars.values(), np.float64, len(self.chars))
            code = np.minimum(code, 0xFFFF)
            held = np.bincount(FOLDED[code], n, LETTERS)
            count = np.bincount(code, n, 0x10000)
            within = np.where(held[FOLDED] > 0, (count + 0.05) / (held[FOLDED] + 0.05 * 24_000), 1 / 24_000)
            within[FOLDED < SHARED] = 1
            self._made = p, np.log(within).astype(np.float32), left, base
        return self._made

    def sums(self, k: np.ndarray, starts: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """log P of each text from the classes of a layout."""
        steps = self.made()[0].ravel()[k[:-1] * LETTERS + k[1:]]
        if more is not None:
            steps = steps + more[1:]
        return np.add.reduceat(steps, starts - 1) if len(starts) else np.empty(0, np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        c, starts = _laid_out(texts)
        return self.sums(FOLDED[c], starts, self.made()[1][c])

    def score_without(self, word: str, n: int) -> float:
        """log P of a word by the counts of all other words: n times this word's pairs are left out."""
        _, within, left, base = self.made()
        c, _ = _laid_out([word])
        k = FOLDED[c].astype(np.int64)
        own = Counter((k[:-1] * LETTERS + k[1:]).tolist())
        out = 0.0
        for a, b, x in zip(k[:-1].tolist(), k[1:].tolist(), c[1:].tolist()):
            code = a * LETTERS + b
            at = np.searchsorted(self.code, code)
            seen = self.n[at] if at < len(self.code) and self.code[at] == code else 0.0
            out += math.log((max(0.0, seen - n * own[code]) + 20.0 * base[b]) / (left[a] + 20.0)) + float(within[x])
        return out


_BAD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f�￰-￿-]")


SINGLE = tuple(p for p in READ_AS if p not in SEVERAL)
TABLES = {(r, m): f"{r}>{m}" for r in SINGLE for m in MEANT_AS if m not in SEVERAL and r != m}


@lru_cache(None)
def _bytes_of(page: str) -> np.ndarray:
    """Code point to byte of a single-byte page, -1 where it has none."""
    out = np.full(0x10000, -1, np.int16)
    for c, b in _page(page).items():
        out[ord(c)] = b
    return out


@lru_cache(None)
def _meant_by(page: str) -> np.ndarray:
    """Byte to code point of a single-byte page; 0xFFFF where it has none or one that no text holds. The last entry stands for no byte."""
    out = np.full(257, 0xFFFF, np.int32)
    for b in range(256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            continue
        if not _BAD.search(c):
            out[b] = ord(c)
    return out


@lru_cache(None)
def table_of(cipher: str) -> dict[int, int]:
    """A cipher of single characters as a table for translate()."""
    read, meant = cipher.split(">")
    to = _meant_by(meant)
    return {ord(c): int(to[b]) for c, b in _page(read).items() if to[b] != 0xFFFF}


def _in_parts(raw: bytes, upper: bool) -> str | None:
    y = raw.decode("utf_8", "replace")
    lost = y.count(LOST)
    whole = sum(c > "\x7f" for c in y) - lost
    at_end = lost == 1 and y.endswith(LOST) and raw[-1] in (0xC2, 0xC3) and upper and len(y) > 2 and y[-2].islower()
    if _BAD.search(y.replace(LOST, "")) or not (whole >= lost > 0 and whole >= 2 or at_end):
        return None
    return y


def readings(word: str, tables: bool = True) -> dict[str, str]:
    """Every other reading of a word: {cipher: text}. A cipher is read>meant, with xN for text garbled N times over.

    Without ``tables``, those that substitute single characters are left out.
    """
    out: dict[str, str] = {}
    seen = {word}
    held: dict[bytes, str] = {}
    for page in READ_AS:
        if (raw := to_bytes(word, page)) is not None and raw not in held:
            held[raw] = page
    for raw, page in held.items():
        for meant in MEANT_AS:
            if meant == page or not tables and (page, meant) in TABLES:
                continue
            try:
                y = raw.decode(meant)
            except UnicodeDecodeError:
                if meant == "utf_8" and (y := _in_parts(raw, not word[-1].islower())) and y not in seen:  # a sequence was cut or lost a byte
                    seen.add(y)
                    out[f"{page}>utf_8"] = y
                continue
            if y in seen or meant in ("cp932", "euc_jp", "gbk") and sum("\u3000" <= c <= "\u9fff" for c in y) < 2:
                continue
            seen.add(y)
            name, times = f"{page}>{meant}", 1
            if not _BAD.search(y):
                out[name] = y
            while meant == "utf_8" and times < 4 and not y.isascii() and (again := to_bytes(y, page)) is not None:
                try:
                    z = again.decode(meant)
                except UnicodeDecodeError:
                    break
                if z in seen:
                    break
                y, times = z, times + 1
                if not _BAD.search(y):
                    out[f"{name}x{times}"] = y
    for wide in WIDE:  # pairs of ASCII bytes that were read as one character
        parts = re.split(r"([^\x00-\x7f]+)", word)
        y = "".join(p if k % 2 == 0 else p.encode(wide, "surrogatepass").decode("latin-1") for k, p in enumerate(parts))
        if y not in seen and y.isascii() and not _BAD.search(y):
            out[wide] = y
    return out


def _to_try(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words of a layout may have a reading that is no substitution of single characters."""
    high = c > 0x7F
    n_high = np.add.reduceat(high.astype(np.int32), starts)
    wide, low = c >> 8, c & 0xFF
    printable = (wide >= 0x20) & (wide <= 0x7E) & (((low >= 0x20) & (low <= 0x7E)) | ((low >= 9) & (low <= 13)))
    out = (n_high >= 4) | np.logical_or.reduceat((c >= 0x2E80) | printable, starts)
    ends = np.append(starts[1:] - 2, len(c) - 2)
    for page in SINGLE:  # a sequence of UTF-8, or the first half of one at the end
        b = _bytes_of(page)[c]
        lead = (b >= 0xC2) & (b <= 0xF4)
        lead[:-1] &= (b[1:] >= 0x80) & (b[1:] <= 0xBF)
        lead[-1] = False
        out |= np.logical_or.reduceat(lead, starts) | (b[ends] == 0xC2) | (b[ends] == 0xC3)
    return out


class Model:
    """Clean bigrams, and how frequent each cipher is in each column and source."""

    def __init__(self, bigrams: Bigrams, share: dict[tuple[str, str], dict[str, float]], sizes: dict[tuple[str, str], float], clean: dict[str, float]):
        """share: garbled words per (tab, source) and cipher; sizes: words of those sources; clean: words per column."""
        self.bigrams, self.first = bigrams, not share
        column: dict[str, Counter] = {tab: Counter() for tab in clean}
        for (tab, _), mine in share.items():
            column[tab].update(mine)
        self.names = list(TABLES.values())
        self.column, self.unseen, self.base = {}, {}, {}
        for tab, n in clean.items():
            total = n + sum(column[tab].values()) + 1.0
            self.base[tab, None] = max(n, 1.0) / total
            self.unseen[tab] = 0.5 / total
            self.column[tab] = {z: (k + 0.5) / total for z, k in column[tab].items()}
        self.share, self.sizes = share, sizes
        for key, n in sizes.items():
            own = max(n - sum(share[key].values()), 0.0)
            self.base[key] = (own + DRAWN * self.base[key[0], None]) / (n + DRAWN)
        self._rows: dict[tuple[str, str], np.ndarray] = {}

    def base_of(self, tab: str, source: str) -> float:
        return math.log(self.base.get((tab, source), self.base[tab, None]))

    def prior_of(self, tab: str, source: str, cipher: str) -> float:
        if self.first:  # sequences that decode by chance are rare, single bytes that do are not
            return -1.0 if "utf_" in cipher else -4.0 if cipher.endswith(("euc_jp", "cp932")) else -8.0
        p, key = self.column[tab].get(cipher, self.unseen[tab]), (tab, source)
        if key in self.sizes:
            p = (self.share[key].get(cipher, 0.0) + DRAWN * p) / (self.sizes[key] + DRAWN)
        return math.log(p)

    def _priors(self, key: tuple[str, str]) -> np.ndarray:
        if key not in self._rows:
            if len(self._rows) > 10_000:
                self._rows.clear()
            self._rows[key] = np.array([self.prior_of(*key, z) for z in self.names], np.float32)
        return self._rows[key]

    def _substituted(self, c: np.ndarray, starts: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """log P of each word's reading under each cipher of single characters."""
        out = np.full((len(starts), len(self.names)), -np.inf, np.float32)
        spans = np.diff(np.append(starts, len(c)))
        within = self.bigrams.made()[1]
        at = {z: i for i, z in enumerate(self.names)}
        for read in SINGLE:
            b = _bytes_of(read)[c]
            ok = np.minimum.reduceat(b, starts) >= 0
            if not ok.any():
                continue
            chosen = np.concatenate(([32], b[1:][np.repeat(ok, spans)])) if not ok.all() else b
            n = spans[ok]
            begin = np.cumsum(n) - n + 1
            for meant in MEANT_AS:
                if (read, meant) not in TABLES:
                    continue
                to = _meant_by(meant)
                classes = np.where(to == 0xFFFF, _BARRED, FOLDED[to])
                more = np.where(to == 0xFFFF, 0, within[to]).astype(np.float32)
                score = self.bigrams.sums(classes[chosen], begin, more[chosen] if more.any() else None)
                out[ok, at[TABLES[read, meant]]] = np.where(score > -1e5, score, -np.inf)
        return out

    def read(self, tabs: list[str], sources: list[str], words: list[str], counts: list[int], all_counts: list[int]) -> list[tuple]:
        """(tab, source, word, n, cipher, text, n_all, whether in doubt) of the words whose best reading is likelier than that they are clean.

        In doubt is a reading that is likelier only by the counts of the other words; n_all counts the word in all sources.
        """
        if not words:
            return []
        index: dict[str, int] = {}
        of = np.array([index.setdefault(w, len(index)) for w in words])
        distinct = list(index)
        c, starts = _laid_out(distinct)
        clean = self.bigrams.scores(distinct)
        tables = self._substituted(c, starts, clean)
        others: dict[int, list[tuple[str, str, float]]] = {}
        trial = [(i, z, y) for i in np.flatnonzero(_to_try(c, starts)).tolist() for z, y in readings(distinct[i], tables=False).items()]
        for (i, z, y), s in zip(trial, self.bigrams.scores([y for _, _, y in trial]).tolist() if trial else ()):
            others.setdefault(i, []).append((z, y, s))
        keys = list(zip(tabs, sources))
        number: dict[tuple[str, str], int] = {}
        key_of = np.array([number.setdefault(k, len(number)) for k in keys])
        priors = np.stack([self._priors(k) for k in number])
        base = np.array([self.base_of(*k) for k in number])
        here = base[key_of] + clean[of]
        best = np.empty(len(words), np.int64)
        top = np.empty(len(words))
        for s in range(0, len(words), 4096):
            total = tables[of[s : s + 4096]] + priors[key_of[s : s + 4096]]
            best[s : s + 4096] = total.argmax(1)
            top[s : s + 4096] = total.max(1)
        n_chars = np.fromiter(map(len, words), np.int64, len(words))
        unlikely = (here < -4 * n_chars) & (n_chars > 2)
        out = []
        look = (top > here) | (unlikely & (top > -np.inf))
        look |= np.isin(of, np.fromiter(others, np.int64, len(others)))
        for i in np.flatnonzero(look).tolist():
            word, key = words[i], keys[i]
            found = None
            if top[i] > -np.inf:
                row = tables[of[i]] + priors[key_of[i]]
                for z in np.argsort(-row, kind="stable").tolist():
                    if row[z] == -np.inf:
                        break
                    y = word.translate(table_of(self.names[z]))
                    if y != word:
                        found = (self.names[z], y, float(row[z]))
                        break
            for z, y, s in others.get(int(of[i]), ()):
                s += self.prior_of(*key, z)
                if found is None or s > found[2]:
                    found = (z, y, s)
            if found is None:
                continue
            if found[2] > here[i]:
                out.append((*key, word, counts[i], *found[:2], all_counts[i], False))
            elif unlikely[i] and found[2] > self.base_of(*key) + self.bigrams.score_without(word, all_counts[i]) + 3:  # unlikely, though itself among the counts
                out.append((*key, word, counts[i], *found[:2], all_counts[i], True))
        return out


def _values(frames: list[tuple]) -> DataFrame:
    """(tab, row_id, source, text) of (tab, frame, id column, text column[, source column]); without the last, all is one source."""
    out = None
    for tab, df, id_col, text_col, *source in frames:
        named = F.coalesce(F.regexp_replace(F.lower(F.trim(F.col(source[0]).cast("string"))), r"[\s_-]+", "-"), F.lit("")) if source else F.lit("")
        part = df.select(F.lit(tab).alias("tab"), F.col(id_col).cast("long").alias("row_id"), named.alias("source"), F.col(text_col).cast("string").alias("text")).where("row_id is not null and length(text) > 0")
        out = part if out is None else out.unionByName(part)
    return out


_BLANKS = {ord(c): " " for c in "\t\n\r\f\x0b"}


def _rows_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _tally(values: DataFrame) -> DataFrame:
    """(kind, tab, source, word, code, n): class pairs (0), characters of shared classes (1), words beyond ASCII (2), counted over all values."""
    names, kinds = ["kind", "tab", "source", "word", "code", "n"], [pa.int8(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(LETTERS * LETTERS, np.int64)
        chars: Counter = Counter()
        tokens: Counter = Counter()

        for batch in batches:
            texts = batch.column(0).to_pylist()
            c, _ = _laid_out(texts)
            k = FOLDED[c]
            for s in range(0, len(k) - 1, 1 << 22):
                part = k[s : s + (1 << 22) + 1]
                code, n = np.unique(part[:-1] * LETTERS + part[1:], return_counts=True) if len(part) < 1 << 17 else (None, np.bincount(part[:-1] * LETTERS + part[1:], minlength=LETTERS * LETTERS))
                if code is None:
                    pairs += n
                else:
                    pairs[code] += n
            code, n = np.unique(c[k >= SHARED], return_counts=True)
            chars.update(dict(zip(code.tolist(), n.tolist())))
            for tab, source, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts):
                if not t.isascii():
                    tokens.update([(tab, source, w) for w in t.translate(_BLANKS).split(" ") if not w.isascii()])
            if len(tokens) > 200_000:
                yield _rows_of([(2, t, s, w, 0, n) for (t, s, w), n in tokens.items()], names, kinds)
                tokens = Counter()
        code = np.flatnonzero(pairs)
        yield _rows_of([(0, "", "", "", c, n) for c, n in zip(code.tolist(), pairs[code].tolist())] + [(1, "", "", "", c, n) for c, n in chars.items()]
                       + [(2, t, s, w, 0, n) for (t, s, w), n in tokens.items()], names, kinds)

    counted = values.select("text", "tab", "source").mapInArrow(count, "kind byte, tab string, source string, word string, code long, n long")
    return counted.groupBy("kind", "tab", "source", "word", "code").agg(F.sum("n").alias("n"))


FOUND = "tab string, source string, word string, n long, cipher string, reading string"
_FOUND = ["tab", "source", "word", "n", "cipher", "reading"]


def _expect(words: DataFrame, model: Model) -> DataFrame:
    """E step: (tab, source, word, n, cipher, reading) of the words that are likelier garbled than clean."""
    shared = words.sparkSession.sparkContext.broadcast(model)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows, rest = [], []
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if LOST in row[2]:
                    rows.append((*row[:4], "lost", row[2], row[4], False))
                else:
                    rest.append(row)
            yield _rows_of(rows + (model.read(*map(list, zip(*rest))) if rest else []), [*_FOUND, "n_all", "doubt"], kinds)

    read_all = materialize(words.select(*_FOUND[:4], "n_all").mapInArrow(read, FOUND + ", n_all long, doubt boolean"), "encoding-readings")
    # a doubtful reading holds if it is itself a word that is seen more often
    held = read_all.where("doubt").join(_seen(words), ["tab", "reading"]).where("seen > n_all")
    return read_all.where("not doubt").select(*_FOUND).unionByName(held.select(*_FOUND))


def _seen(words: DataFrame) -> DataFrame:
    return words.groupBy("tab", F.col("word").alias("reading")).agg(F.sum("n").alias("seen"))


def _maximise(bigrams: Bigrams, found: DataFrame, words: DataFrame, clean: dict[str, float]) -> Model:
    """M step: cipher frequencies, and bigrams without the garbled words but with their readings."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for word, n, cipher, reading in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                for text, sign in ((word, -n), (reading, n)) if cipher != "lost" else ((word, -n),):
                    k = FOLDED[_laid_out([text])[0]]
                    for code in (k[:-1] * LETTERS + k[1:]).tolist():
                        tally[code] += sign
        yield _rows_of(list(tally.items()), ["code", "n"], [pa.int64(), pa.int64()])

    changed = {r["code"]: r["n"] for r in found.mapInArrow(pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    share: dict[tuple[str, str], dict[str, float]] = {}
    counted = found.where("cipher <> 'lost'").groupBy("tab", "source", "cipher").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # ciphers times the sources that have garbled words
        share.setdefault((r["tab"], r["source"]), {})[r["cipher"]] = float(r["n"])
    with_some = counted.select("tab", "source").distinct()
    sizes = {(r["tab"], r["source"]): float(r["n"]) for r in words.join(F.broadcast(with_some) if len(share) <= 100_000 else with_some, ["tab", "source"], "left_semi").groupBy("tab", "source").agg(F.sum("n").alias("n")).collect()}
    code, n = np.fromiter(changed, np.int64, len(changed)), np.fromiter(changed.values(), np.float64, len(changed))
    all_code, back = np.unique(np.concatenate((bigrams.code, code)), return_inverse=True)
    new = Bigrams(all_code, np.bincount(back, np.concatenate((bigrams.n, n)), len(all_code)), bigrams.chars)
    garbled = Counter()
    for (tab, _), mine in share.items():
        garbled[tab] += sum(mine.values())
    return Model(new, share, {k: sizes.get(k, 0.0) for k in share}, {tab: n - garbled[tab] for tab, n in clean.items()})


# --- the cipher of a source whose symbols are not known


SYMBOLS = "".join(sorted({c for p in SINGLE for c, b in _page(p).items() if b > 127 and not _BAD.search(c)}))


def _strange(words: DataFrame, least: int = 20, times: float = 4.0) -> tuple[dict[tuple[str, str], set[str]], dict[str, float]]:
    """({(tab, source): symbols}, {letter: count}): characters a source uses ``times`` as often as the others, and the letters beyond ASCII by frequency."""
    counted = words.select("tab", "source", "n", F.explode(F.split("word", "")).alias("c")).where("c > '\x7f'")
    per = materialize(counted.groupBy("tab", "source", "c").agg(F.sum("n").alias("n")), "encoding-symbols")
    whole = per.groupBy("tab", "source").agg(F.sum("n").alias("size"))
    every = per.groupBy("tab", "c").agg(F.sum("n").alias("n_all"))
    total = per.groupBy("tab").agg(F.sum("n").alias("size_all"))
    odd = per.where((F.col("n") >= least) & F.col("c").isin(list(SYMBOLS))).join(whole, ["tab", "source"]).join(every, ["tab", "c"]).join(total, "tab")
    odd = odd.where("n_all > n or size_all > size").where(F.col("n") * (F.col("size_all") - F.col("size")) >= times * (F.col("n_all") - F.col("n")) * F.col("size")).where("size_all > size")
    symbols: dict[tuple[str, str], set[str]] = {}
    for r in odd.select("tab", "source", "c").collect():  # at most the symbols of the sources that have some
        symbols.setdefault((r["tab"], r["source"]), set()).add(r["c"])
    letters = {r["c"]: float(r["n"]) for r in per.groupBy("c").agg(F.sum("n").alias("n")).where(F.col("c").rlike(r"^\p{L}$")).orderBy(F.desc("n"), "c").limit(LEARNED_FROM).collect()} if symbols else {}
    return symbols, letters


LEARNED_FROM = 160  # letters a symbol may stand for


def _posteriors(word: str, symbols: set[str], letters: list[str], step: np.ndarray, emits: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray]]:
    """(symbol, P(letter)) of each symbol of a word, by forward-backward over the bigrams; step is P(b | a) of classes."""
    classes = FOLDED[[min(ord(x), 0xFFFF) for x in letters]]
    at = [classes if x in symbols else FOLDED[[min(ord(x), 0xFFFF)]] for x in f" {word} "]
    seen = [emits[x] if x in symbols else np.ones(1) for x in f" {word} "]
    forward, backward = [seen[0]], [np.ones(len(at[-1]))]
    for a, b, e in zip(at, at[1:], seen[1:]):
        v = (forward[-1] @ step[np.ix_(a, b)]) * e
        forward.append(v / max(v.sum(), 1e-300))
    for i in range(len(at) - 2, -1, -1):
        v = step[np.ix_(at[i], at[i + 1])] @ (seen[i + 1] * backward[-1])
        backward.append(v / max(v.sum(), 1e-300))
    for x, f, b in zip(f" {word} ", forward, reversed(backward)):
        if x in symbols:
            p = f * b
            yield x, p / max(p.sum(), 1e-300)


def _learned(words: DataFrame, found: DataFrame, bigrams: Bigrams, rounds: int = 12) -> DataFrame | None:
    """(tab, source, word, n, cipher, reading) of the words under a cipher that was learned; None if no source has strange symbols."""
    spark = words.sparkSession
    rest = words.join(found.select("tab", "source", "word"), ["tab", "source", "word"], "left_anti")
    symbols, frequent = _strange(rest)
    if not symbols:
        return None
    letters = {key: [x for x in frequent if x not in odd] for key, odd in symbols.items()}
    symbols = {key: odd for key, odd in symbols.items() if letters[key]}
    shared = spark.sparkContext.broadcast((symbols, letters, bigrams))
    rows_kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.value[0]
        for batch in batches:
            rows = [r for r in zip(*(batch.column(k).to_pylist() for k in range(4))) if (odd := symbols.get(r[:2])) and not odd.isdisjoint(r[2])]
            yield _rows_of(rows, _FOUND[:4], rows_kinds)

    odd_words = materialize(rest.select(*_FOUND[:4]).mapInArrow(pick, "tab string, source string, word string, n long"), "encoding-odd")
    emits = {key: {x: np.full(len(letters[key]), 1 / len(odd)) for x in odd} for key, odd in symbols.items()}
    belief: dict[tuple[str, str, str], np.ndarray] = {}
    likeliest: dict[tuple[str, str, str], int] = {}
    for _ in range(rounds):
        emitted = spark.sparkContext.broadcast(emits)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            symbols, letters, bigrams = shared.value
            step, emits = np.exp(bigrams.made()[0]), emitted.value
            sums: dict[tuple[str, str, str], np.ndarray] = {}
            for batch in batches:
                for tab, source, word, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    key = (tab, source)
                    for x, p in _posteriors(word, symbols[key], letters[key], step, emits[key]):
                        sums[tab, source, x] = sums.get((tab, source, x), 0) + p * math.log1p(n)  # repeated words teach little more
            yield _rows_of([(*k, y, float(v)) for k, p in sums.items() for y, v in zip(letters[k[:2]], p) if v > 1e-3], ["tab", "source", "symbol", "letter", "n"], [pa.string()] * 4 + [pa.float64()])

        belief = {}
        place = {key: {y: i for i, y in enumerate(ls)} for key, ls in letters.items()}
        for r in odd_words.mapInArrow(expect, "tab string, source string, symbol string, letter string, n double").groupBy("tab", "source", "symbol", "letter").agg(F.sum("n").alias("n")).collect():  # symbols times letters
            key = (r["tab"], r["source"])
            belief.setdefault((*key, r["symbol"]), np.zeros(len(letters[key])))[place[key][r["letter"]]] = r["n"]
        before, likeliest = likeliest, {k: int(n.argmax()) for k, n in belief.items()}
        emits = {}
        for key, odd in symbols.items():
            counts = {x: belief.get((*key, x), np.zeros(len(letters[key]))) + 0.01 for x in odd}
            whole = np.sum(list(counts.values()), 0)
            emits[key] = {x: c / whole for x, c in counts.items()}
        if likeliest == before:
            break
    tables: dict[tuple[str, str], dict[str, str]] = {}
    for (tab, source, x), n in belief.items():
        if n.max() >= 0.6 * n.sum():
            tables.setdefault((tab, source), {})[x] = letters[tab, source][int(n.argmax())]
    given = spark.sparkContext.broadcast(tables)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, bigrams = shared.value
        for batch in batches:
            rows = [r for r in zip(*(batch.column(k).to_pylist() for k in range(4))) if r[:2] in given.value]
            texts = [r[2].translate(str.maketrans(given.value[r[:2]])) for r in rows]
            scores = bigrams.scores(texts).tolist() if texts else []
            own = [bigrams.score_without(r[2], r[3]) for r in rows]
            yield _rows_of([(*r, "learned", y, s > o) for r, y, s, o in zip(rows, texts, scores, own) if y != r[2]], [*_FOUND, "likelier"], [*rows_kinds, pa.string(), pa.string(), pa.bool_()])

    read = materialize(odd_words.mapInArrow(apply, FOUND + ", likelier boolean").join(_seen(words), ["tab", "reading"], "left").select(*_FOUND, "likelier", (F.coalesce("seen", F.lit(0)) >= F.col("n")).alias("known")), "encoding-learned")
    each = read.select("tab", "source", "known", F.explode(F.array_distinct(F.split("word", ""))).alias("symbol"))
    kept: dict[tuple[str, str], set[str]] = {}
    whole = read.groupBy("tab", "source").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("known").cast("int")).alias("known")).where(f"known >= {LEAST_WORDS} and 2 * known >= all")
    sure = {(r["tab"], r["source"]) for r in whole.collect()}
    for r in each.groupBy("tab", "source", "symbol").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("known").cast("int")).alias("known")).where("symbol > '\x7f' and known >= 1 and 2 * known >= all").collect():
        if (r["tab"], r["source"]) in sure and r["symbol"] in tables.get((r["tab"], r["source"]), {}):
            kept.setdefault((r["tab"], r["source"]), set()).add(r["symbol"])
    if not kept:
        return None
    sure = spark.createDataFrame([(t, s, "".join(sorted(x for x in symbols[t, s] if x not in odd))) for (t, s), odd in kept.items()], "tab string, source string, unsure string")
    out = read.join(F.broadcast(sure), ["tab", "source"]).where("(known or likelier) and translate(word, unsure, '') = word")
    return out.select(*_FOUND)


def garbled_words(values: DataFrame, rounds: int = 3) -> DataFrame:
    """(tab, source, word, n, cipher, reading) of all distinct garbled words; letters that are lost stay U+FFFD in the reading."""
    tally = materialize(_tally(values), "encoding-tally")
    pairs = tally.where("kind = 0").select("code", "n").toArrow()  # at most LETTERS squared
    chars = {r["code"]: float(r["n"]) for r in tally.where("kind = 1").select("code", "n").collect()}  # at most all characters
    words = tally.where("kind = 2").select("tab", "source", "word", "n")
    spark = values.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-words.count() // 50_000))
    # a word's rows stand together, so that it is read once
    every = F.expr("sum(n) over (partition by tab, word)").alias("n_all")
    words = materialize(words.repartition(parts, "word").select("*", every).sortWithinPartitions("word"), "encoding-words")
    clean = {r["tab"]: float(r["n"]) for r in words.groupBy("tab").agg(F.sum("n").alias("n")).collect()}
    start = Bigrams(pairs.column("code").to_numpy(), pairs.column("n").to_numpy(), chars)
    model = Model(start, {}, {}, clean)
    for k in range(rounds):
        found = materialize(_expect(words, model), "encoding-found")
        if k < rounds - 1:
            model = _maximise(start, found, words, clean)
    learned = _learned(words, found, model.bigrams)
    return found if learned is None else materialize(found.unionByName(learned), "encoding-found")


def repair(values: DataFrame, found: DataFrame, limit: int = 300_000) -> DataFrame:
    """(tab, row_id, n_garbled, ciphers, repaired) of the values that hold a garbled word.

    The garbled words go to every task if they are at most ``limit``; beyond that
    words and values are joined in the cluster, with the same result.
    """
    spark = values.sparkSession
    schema = "tab string, row_id long, n_garbled int, ciphers string, repaired string"
    names, kinds = ["tab", "row_id", "n_garbled", "ciphers", "repaired"], [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    if "source" not in found.columns:
        found = found.withColumn("source", F.lit(""))

    def fix(table: dict[str, tuple[str, str]], tab, row_id, text):
        used: list[str] = []

        def one(m: re.Match) -> str:
            if hit := table.get(m.group()):
                used.append(hit[0])
                return hit[1]
            return m.group()

        fixed = WORD.sub(one, text)
        return (tab, row_id, len(used), "+".join(sorted(set(used))), fixed) if used else None

    if found.limit(limit + 1).count() <= limit:
        tables: dict[tuple[str, str], dict[str, tuple[str, str]]] = {}
        for r in found.select("tab", "source", "word", "cipher", "reading").collect():
            tables.setdefault((r["tab"], r["source"]), {})[r["word"]] = (r["cipher"], r["reading"])
        shared = spark.sparkContext.broadcast(tables)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for tab, row_id, source, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    if not text.isascii() and (table := shared.value.get((tab, source))) and not table.keys().isdisjoint(text.translate(_BLANKS).split(" ")):
                        rows.append(fix(table, tab, row_id, text))
                yield _rows_of(rows, names, kinds)

        return values.select("tab", "row_id", "source", "text").mapInArrow(apply, schema).distinct()

    keys = ["tab", "source", "row_id"]
    hits = values.select(*keys, F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0)))).alias("word")).distinct()
    hits = hits.join(found.select("tab", "source", "word", "cipher", "reading"), ["tab", "source", "word"]).groupBy(*keys, "h").agg(F.collect_list(F.struct("word", "cipher", "reading")).alias("words"))
    joined = values.withColumn("h", F.xxhash64("text")).join(hits, [*keys, "h"]).select("tab", "row_id", "text", "words")

    def apply_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fix({w["word"]: (w["cipher"], w["reading"]) for w in words}, tab, row_id, text) for tab, row_id, text, words in zip(*(batch.column(k).to_pylist() for k in range(4)))]
            yield _rows_of([r for r in rows if r], names, kinds)

    return joined.mapInArrow(apply_own, schema).distinct()


def _project(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    docs = table(spark, sf_dir, "documents")
    sources = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("from_source"))
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "text").join(sources.hint("shuffle_hash"), "doc_id", "left")
    return _values([("chunks", chunks, "chunk_id", "text", "from_source"), ("documents", docs, "doc_id", "type", "source")])


def p1_repaired(spark, sf_dir: str) -> DataFrame:
    """Each concerned value as it read before, as far as that can be told, with the ciphers found in it."""
    values = _project(spark, sf_dir)
    return repair(values, garbled_words(values))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return p1_repaired(spark, sf_dir).select("tab", "row_id").distinct()
