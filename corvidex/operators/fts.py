"""Keyword retrieval: weighted BM25 over chunk fields, prefix words joined by AND.

k1 = 1.2, b = 0.75; a word's frequency in a chunk is the weighted sum over the
fields; a chunk's length counts all fields' tokens unweighted; idf is
ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that is not positive. Ranks are
negative, smaller is better, ties go to the smaller id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem
from ..functions.text import folded, tokens
from ..session import fan_out, materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# fixed values: weights of path, heading and text
WEIGHTS = {"fts_path": 10.0, "heading": 2.0, "text": 1.0}


def query_phrases(query: str, fold: bool = True) -> list[tuple[str, ...]]:
    """The query's words as phrases of tokens, the last one a prefix: ``_`` joins words but parts tokens. A lone ``_`` is an empty phrase."""
    low = folded if fold else str.lower
    return [tuple(re.findall(r"[^\W_]+", low(w))) for w in re.findall(r"\w+", query)]


def _ends(tokens: Column, phrase: tuple[str, ...]):
    """Whether the phrase ends at a token."""
    def at(token: Column, i: Column) -> Column:
        ok = token.startswith(phrase[-1])
        for back, word in enumerate(reversed(phrase[:-1]), 1):
            ok = ok & (F.get(tokens, i - back) == word)
        return ok

    return at if len(phrase) > 1 else lambda token: token.startswith(phrase[0])


def chunk_words(chunks: DataFrame, phrases: list[tuple[str, ...]], weights: dict[str, float] | None = None, fold: bool = True) -> DataFrame:
    """(chunk_id, len, f0, f1, ...): each chunk's token count and weighted frequency of each phrase; rows repeated whole stay."""
    weights = weights or WEIGHTS
    rows = fan_out(chunks.select("chunk_id", *weights)).select("chunk_id", *[tokens(F.col(f), fold).alias(f) for f in weights])
    length = sum((F.size(f) for f in weights), F.lit(0))
    cols = [length.cast("long").alias("len")]
    for i, p in enumerate(phrases):
        cols.append(sum((F.size(F.filter(F.col(f), _ends(F.col(f), p))) * F.lit(k) for f, k in weights.items()), F.lit(0.0)).alias(f"f{i}"))
    return rows.select("chunk_id", *cols)


def _ranked(counted: DataFrame, n_words: int, total: int, average: float, matching: list[int]) -> DataFrame:
    """(chunk_id, fts_rank) of the rows that hold every phrase, from each phrase's number of chunks."""
    score, every = F.lit(0.0), F.lit(True)
    for i in range(n_words):
        idf = math.log((total - matching[i] + 0.5) / (matching[i] + 0.5))
        f = F.col(f"f{i}")
        score = score + F.lit(idf if idf > 0 else LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(float(average))))
        every = every & (f > 0)
    return counted.where(every).select("chunk_id", (-score).alias("fts_rank"))


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "chunk_id long, fts_rank double")


def bm25(chunks: DataFrame, query: str, weights: dict[str, float] | None = None, allowed: DataFrame | None = None, fold: bool = True) -> DataFrame:
    """(chunk_id, fts_rank) of all chunks that hold every word of the query, unstemmed, from the texts themselves.

    ``allowed`` (chunk_id) restricts the result, not the statistics. A query
    without a word or with a lone ``_``, like an empty table, gives no rows.
    Diacritics are folded on both sides unless ``fold`` is off. Texts are read
    once and not shuffled (but to spread a table of a few files): repeated chunks
    are dropped from the counts, which are written and read for statistics and
    matches. With a stored index, search_postings() reads no text at all.
    """
    words = query_phrases(query, fold)
    if not words or not all(words):
        return _none(chunks)
    counted = chunk_words(chunks, words, weights, fold)
    once = materialize(counted.groupBy("chunk_id").agg(F.first("len").alias("len"), *[F.first(f"f{i}").alias(f"f{i}") for i in range(len(words))]), "word-counts")
    stats = once.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(words))]).first()
    hits = _ranked(once, len(words), stats["n"], stats["avg"] or 1.0, [stats[f"n{i}"] or 0 for i in range(len(words))])
    return hits.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi") if allowed is not None else hits


def normalised(rank):
    """|r| / (1 + |r|), in [0, 1)."""
    return F.abs(rank) / (1 + F.abs(rank))


# --- the inverted index

FIELD = 1 << 24  # a place is the field's number times this, plus the token's position


def build_postings(chunks: DataFrame, stemmed: bool = True, fold: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, chunk_id, len, wtf, places, keep..): the inverted index, to be written sorted by term.

    ``wtf`` is the frequency weighted by field, ``len`` the chunk's tokens in all
    fields, ``places`` the sorted places for phrases. Repeated chunks count once,
    after their texts have been cut into words in place; the stemmer runs over the
    distinct words of a batch.
    """
    fields, weights = list(WEIGHTS), list(WEIGHTS.values())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(r"[^\W_]+").findall
        low = folded if fold else str.lower
        stems: dict[str, str] = {}
        for batch in batches:
            for s in range(0, len(batch), 500):
                part = batch.slice(s, 500)
                texts = [part.column(1 + i).to_pylist() for i in range(len(fields))]
                terms, row, length, weight, ends, flat = [], [], [], [], [0], []
                for r, values in enumerate(zip(*texts)):
                    at: dict[str, list[int]] = {}
                    count = 0
                    for i, v in enumerate(values):
                        found = words(low(v)) if v else ()
                        count += len(found)
                        for place, word in enumerate(found, i * FIELD):
                            if stemmed:
                                if (term := stems.get(word)) is None:
                                    if len(stems) > 500_000:
                                        stems.clear()
                                    term = stems[word] = stem(word)
                                word = term
                            if word in at:
                                at[word].append(place)
                            else:
                                at[word] = [place]
                    for term, places in at.items():
                        terms.append(term)
                        flat += places
                        ends.append(len(flat))
                    row += [r] * len(at)
                    length += [count] * len(at)
                places = np.array(flat, np.int32)
                each = np.array(weights)[places // FIELD]
                weight = np.add.reduceat(each, ends[:-1]) if terms else np.empty(0)
                of = pa.array(row, pa.int64())
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places))
                cols = [pa.array(terms, pa.string()), part.column(0).take(of), pa.array(length, pa.int32()), pa.array(weight, pa.float64()), listed, *(part.column(1 + len(fields) + i).take(of) for i in range(len(keep)))]
                yield pa.RecordBatch.from_arrays(cols, names=["term", "chunk_id", "len", "wtf", "places", *keep])

    more = "".join(f", {c} {chunks.schema[c].dataType.simpleString()}" for c in keep)
    rows = fan_out(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), *fields, *[F.col(c).alias(f"keep_{c}") for c in keep]))
    return rows.mapInArrow(cut, f"term string, chunk_id long, len int, wtf double, places array<int>{more}").dropDuplicates(["term", "chunk_id"])


def search_postings(postings: DataFrame, query: str, total: int, average: float, allowed: DataFrame | None = None, stemmed: bool = True, fold: bool = True) -> DataFrame:
    """(chunk_id, fts_rank) of all chunks that hold every word of the query, from the inverted index.

    ``total`` and ``average`` are the number of chunks and their mean length.
    Query words are stemmed as the index is, then match as prefixes; a word that
    ``_`` parts is a phrase. Only postings of matching terms are read (the
    prefixes are pushed down to the scan); nothing but those is shuffled.
    """
    phrases = [tuple(stem(w) if stemmed else w for w in p) for p in query_phrases(query, fold)]
    if not phrases or not all(phrases) or not total:
        return _none(postings)
    term = F.col("term")
    wanted = reduce(or_, [term.startswith(p[-1]) for p in phrases] + [term == w for p in phrases for w in p[:-1]])
    cols = []
    for i, p in enumerate(phrases):
        if len(p) == 1:
            cols.append(F.sum(F.when(term.startswith(p[0]), F.col("wtf")).otherwise(0.0)).alias(f"f{i}"))
        else:  # the places at which the last word's predecessors stand before it
            cols += [F.flatten(F.collect_list(F.when(term.startswith(w) if last else term == w, F.col("places")))).alias(f"p{i}_{k}") for k, w in enumerate(p) for last in [k == len(p) - 1]]
    hits = postings.where(wanted).groupBy("chunk_id").agg(F.first("len").alias("len"), *cols)
    for i, p in enumerate(phrases):
        if len(p) > 1:
            ends = F.col(f"p{i}_{len(p) - 1}")
            for k in range(len(p) - 1):
                ends = F.array_intersect(ends, _moved(F.col(f"p{i}_{k}"), len(p) - 1 - k))
            scores = F.transform(ends, lambda x: F.element_at(F.array(*[F.lit(w) for w in WEIGHTS.values()]), (F.floor(x / FIELD) + 1).cast("int")))
            hits = hits.withColumn(f"f{i}", F.aggregate(scores, F.lit(0.0), lambda s, x: s + x))
    stats = hits.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(phrases))]).first()
    found = _ranked(hits, len(phrases), total, average or 1.0, [stats[f"n{i}"] or 0 for i in range(len(phrases))])
    return found.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi") if allowed is not None else found


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x + by)


def lengths(postings: DataFrame) -> tuple[int, float]:
    """(chunks, mean length) of an index, from its own chunk lengths; chunks without a token are not in it."""
    r = postings.groupBy("chunk_id").agg(F.first("len").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    return r["n"], r["avg"] or 0.0
