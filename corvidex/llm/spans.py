"""Long exact spans shared between records (problem 8).

Method: content-defined chunking with a gear rolling hash, chunks deduplicated
by digest. A 32-bit gear hash depends on the last 32 code points only; a cut
stands at the smallest hash of every window of ``W`` positions, so cuts move
with the text when something is inserted before it, and two cuts are at most
``W`` apart. With W = (span - 32) // 4 + 1 every shared run of ``span`` code
points holds one whole chunk that both texts cut alike.

A chunk's digest is taken over the chunk together with as much text to its left
(one key) or to its right (another key) as any shared run of ``span`` code
points around it must hold on one of its sides. That is what keeps stock
phrases shorter than the span from tying all records that use them.

Ties (same key) are then verified on the texts: on each diagonal the maximal
runs are measured code point by code point.

Keys are brought together by one shuffle and read in order, so that a group of
any size costs no more than its rows. Up to HOT occurrences of a key tie each
other. Beyond that every window of ``span`` code points around an occurrence is
hashed, and the texts that share a window are tied to the smallest of them: rows
grow with the occurrences, not with their square, and a stock phrase shorter
than the span ties nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .pairs import class_members, copy_classes, expand_pairs
from .words import mix64

GEAR = 32
HOT = 64
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gear(c: np.ndarray) -> np.ndarray:
    """h[i] = sum of G[c[i-j]] << j for j < 32, modulo 2**32, by doubling the window."""
    h = (mix64(c.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    k = 1
    while k < GEAR:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))  # numpy evaluates the right side first
        k *= 2
    return h


def cuts(c: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest gear hash (ties: the later) of each window of positions, ascending."""
    n = len(c)
    if n < GEAR + window - 1:
        return np.empty(0, np.int64)
    at = np.arange(n, dtype=np.uint64)
    key = ((gear(c).astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at))[GEAR - 1 :]
    low, k = key, 1
    while 2 * k <= window:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if k < window:
        low = np.minimum(low[: len(low) - (window - k)], low[window - k :])
    where = np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))
    return np.unique(where).astype(np.int64)


def prefix(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash modulo 2**64, and the powers that shift a difference back to 0."""
    with np.errstate(over="ignore"):
        power = np.empty(len(c) + 1, np.uint64)
        power[0] = 1
        power[1:] = _B
        np.multiply.accumulate(power, out=power)
        back = np.empty(len(c) + 1, np.uint64)
        back[0] = 1
        back[1:] = _B_INV
        np.multiply.accumulate(back, out=back)
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(mix64(c.astype(np.uint64) + np.uint64(0x51ED27)) * power[:-1], out=sums[1:])
    return sums, back


def _hash(sums: np.ndarray, back: np.ndarray, a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((sums[b] - sums[a]) * back[a] + mix64((b - a).astype(np.uint64) * np.uint64(2) + np.uint64(side)))


def span_keys(c: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of a text: for each chunk one key reaching left and one reaching right."""
    window = (span - GEAR) // 4 + 1
    p = cuts(c, window)
    if len(p) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    start, end = p[:-1] - (GEAR - 1), p[1:] + 1  # with the gear window that fixes the first cut
    more = np.maximum(0, (span - (end - start)) // 2)
    sums, back = prefix(c)
    la, rb = start - more, end + more
    left, right = la >= 0, rb <= len(c)
    return (
        np.concatenate((_hash(sums, back, la[left], end[left], 0), _hash(sums, back, start[right], rb[right], 1))),
        np.concatenate((la[left], start[right])), np.concatenate((end[left], rb[right])),
    )


def windows_at(c: np.ndarray, span: int, keys: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every window of ``span`` code points that holds an occurrence of one of the keys."""
    k, start, end = span_keys(c, span)
    mine = np.fromiter((x in keys for x in k.view(np.int64).tolist()), bool, len(k))
    at = [np.arange(max(0, e - span), min(s, len(c) - span) + 1) for s, e in zip(start[mine].tolist(), end[mine].tolist())]
    at = np.unique(np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64))
    sums, back = prefix(c)
    return _hash(sums, back, at, at + span, 0), at


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, rep, pos) in order of keys: (0, rep_a, rep_b, diagonal) for the keys of up to HOT rows, (1, key, rep, 0) for the rows of others."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], names=["kind", "a", "b", "d"])

    def closed(key: np.ndarray, rep: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups only."""
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        for n in np.unique(size).tolist():
            if n == 1:
                continue
            rows = begin[size == n][:, None] + np.arange(n)
            if n > HOT:
                yield out(1, key[rows].ravel(), rep[rows].ravel(), np.zeros(rows.size))
                continue
            i, j = np.triu_indices(n, 1)
            for s in range(0, len(rows), max(1, 2_000_000 // len(i))):
                part = rows[s : s + max(1, 2_000_000 // len(i))]
                x, y = part[:, i].ravel(), part[:, j].ravel()
                other = rep[x] != rep[y]
                x, y = x[other], y[other]
                first = rep[x] < rep[y]
                x, y = np.where(first, x, y), np.where(first, y, x)
                yield out(0, rep[x], rep[y], pos[x] - pos[y])

    held: tuple[np.ndarray, ...] | None = None
    hot = None  # the key whose first rows have been given already
    for batch in batches:
        now = tuple(batch.column(i).to_numpy() for i in range(3))
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        if not len(now[0]):
            continue
        if hot is not None:
            same = now[0] == hot
            if same.any():
                yield out(1, now[0][same], now[1][same], np.zeros(int(same.sum())))
                now = tuple(x[~same] for x in now)
            if not len(now[0]):
                held = None
                continue
            hot = None
        last = int(np.searchsorted(now[0], now[0][-1]))
        yield from closed(*(x[:last] for x in now)) if last else ()
        held = tuple(x[last:] for x in now)
        if len(held[0]) > HOT:  # too many already: the rest of the group follows row by row
            hot = held[0][0]
            yield out(1, held[0], held[1], np.zeros(len(held[0])))
            held = None
    if held is not None and len(held[0]):
        yield from closed(*held)


def runs_on(a: np.ndarray, b: np.ndarray, diagonal: int, span: int) -> list[tuple[int, int]]:
    """Maximal runs (start in a, length) of at least span equal code points where a's position minus b's is diagonal."""
    lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
    if hi - lo < span:
        return []
    same = (a[lo:hi] == b[lo - diagonal : hi - diagonal]).view(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same, [0]))))
    return [(lo + int(s), int(e - s)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= span]


def shared_runs(documents: DataFrame, span: int = 300) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(runs, members, representatives, sets) of texts of at least ``span`` code points.

    runs: (rep_a, rep_b, start_a, start_b, length), rep_a < rep_b, every maximal
    run of at least ``span`` equal code points between two different texts; of
    texts that meet in a set, those of each with the smallest only. members: the
    classes (rep, id, n, length) of equal texts, representatives: (rep, text).
    sets: (set, rep), the texts that share one of the windows around a hot key;
    None if no key is hot. Null and shorter texts take no part, repeated rows
    count once.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    reps, members = copy_classes(docs, "id", "text", F.length("text") >= span)
    reps = materialize(reps, "span-texts")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, starts = [], [], []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, s, _ = span_keys(codes(text), span)
                keys.append(k)
                starts.append(s)
                ids.append(np.full(len(k), rep, np.int64))
            if keys:
                cols = [np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(starts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "rep", "pos"])

    keys = reps.select("rep", "text").mapInArrow(emit, "key long, rep long, pos int")
    met = materialize(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "kind byte, a long, b long, d int"), "span-met")
    ties = met.where("kind = 0").select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), F.col("d").alias("diagonal"))
    hot = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("rep"))
    sets = None
    if hot.limit(1).count():
        sets, more = _in_sets(hot, reps, span)
        ties = ties.unionByName(more)
    ties = ties.groupBy("rep_a", "rep_b").agg(F.collect_set("diagonal").alias("diagonals"))  # at most the chunks of one text times those of another
    ties = materialize(ties, "span-ties")
    with_a = ties.join(reps.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a")), "rep_a")
    with_b = with_a.join(reps.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ra, rb, ds, ta, tb in zip(*(batch.column(k).to_pylist() for k in range(5))):
                a, b = codes(ta), codes(tb)
                for d in ds:
                    out += [(ra, rb, s, s - d, n) for s, n in runs_on(a, b, d, span)]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=["rep_a", "rep_b", "start_a", "start_b", "length"])

    runs = with_b.select("rep_a", "rep_b", "diagonals", "text_a", "text_b").mapInArrow(verify, "rep_a long, rep_b long, start_a int, start_b int, length int")
    return runs, members, reps, sets


def _in_sets(hot: DataFrame, reps: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(sets(set, rep), ties(rep_a, rep_b, diagonal)) of the texts around hot keys; each text is tied to the smallest of its windows' texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, text, keys in zip(*(batch.column(k).to_pylist() for k in range(3))):
                w, at = windows_at(codes(text), span, set(keys))
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), rep, np.int64)), pa.array(at.astype(np.int32))], names=["w", "rep", "at"])

    texts = reps.join(hot.groupBy("rep").agg(F.collect_set("key").alias("keys")), "rep").select("rep", "text", "keys")  # at most the keys of one text
    windows = materialize(texts.mapInArrow(cut, "w long, rep long, at int"), "span-windows")
    groups = windows.groupBy("w", "rep").agg(F.min("at").alias("at")).groupBy("w").agg(F.min(F.struct("rep", "at")).alias("first"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("n > 1")
    groups = materialize(groups.select("w", "first", F.xxhash64("n", "x", "first.rep").alias("set")), "span-groups")
    # windows of the same texts are one set, told by one of them
    lead = groups.groupBy("set").agg(F.min("w").alias("w"))
    rows = windows.join(groups, "w").select("w", "set", "rep", "at", "first")
    ties = rows.where("rep <> first.rep").select(F.col("first.rep").alias("rep_a"), F.col("rep").alias("rep_b"), (F.col("first.at") - F.col("at")).alias("diagonal")).distinct()
    sets = windows.join(groups.join(lead, ["set", "w"]).select("w", "set"), "w").select("set", "rep").distinct()
    return materialize(sets, "span-sets"), ties


def p8_found(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    runs, members, _, sets = shared_runs(table(spark, sf_dir, "documents"))
    return expand_pairs(_pairs(runs, sets), members, "doc_a", "doc_b")


def _pairs(runs: DataFrame, sets: DataFrame | None) -> DataFrame:
    """(doc_a, doc_b) of the texts that share a run: those of the runs, and of each set all, as is asked for."""
    pairs = runs.select(F.col("rep_a").alias("doc_a"), F.col("rep_b").alias("doc_b"))
    if sets is not None:
        inside = sets.select("set", F.col("rep").alias("doc_a")).join(sets.select("set", F.col("rep").alias("doc_b")), "set").where("doc_a < doc_b")
        pairs = pairs.unionByName(inside.select("doc_a", "doc_b"))
    return pairs.distinct()


def p8_spans(spark, sf_dir: str) -> DataFrame:
    """The shared runs themselves, as positions (0-based) and length.

    Between different texts they run between the representatives of equal texts;
    each further copy has its whole text as a run with its representative
    (``rep_a``). p8_classes tells which documents a representative stands for.
    A stretch around a key of more than HOT texts is given between the smallest
    text that holds it and each other one.
    """
    from ..session import table

    runs, members, _, _ = shared_runs(table(spark, sf_dir, "documents"))
    zero = F.lit(0)
    return runs.unionByName(members.where("rep <> id").select(F.col("rep").alias("rep_a"), F.col("id").alias("rep_b"), zero.alias("start_a"), zero.alias("start_b"), "length"))


def p8_classes(spark, sf_dir: str) -> DataFrame:
    """Each document of at least 300 code points with its class of equal texts (smallest doc_id) and that class's copies, itself included."""
    from ..session import table

    members = class_members(table(spark, sf_dir, "documents"), "doc_id", "text", F.length("text") >= 300)
    return members.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), F.col("n").alias("copies"))


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """Per document: code points, how many of them also stand in another document, and their share.

    One row per distinct doc_id and text with a doc_id; null text counts as
    length 0. A document with an exact copy of at least 300 code points is shared
    in full; otherwise the runs are merged and their union is counted.
    """
    from ..session import table

    docs = table(spark, sf_dir, "documents")
    runs, members, _, _ = shared_runs(docs)
    runs = materialize(runs, "span-runs")
    sides = runs.select(F.col("rep_a").alias("rep"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).unionByName(
        runs.select(F.col("rep_b").alias("rep"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))).distinct()
    union = sides.selectExpr("rep", "s", "e", "coalesce(max(e) over (partition by rep order by s, e rows between unbounded preceding and 1 preceding), 0) as before")
    union = union.groupBy("rep").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before"))).alias("shared"))
    per_id = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_code_points")).where("doc_id is not null").distinct()
    joined = (
        per_id.join(members.select(F.col("id").alias("doc_id"), "rep", "n"), "doc_id", "left")
        .withColumn("rep", F.coalesce("rep", "doc_id")).join(union, "rep", "left")
    )
    shared = F.when(F.col("n") > 1, F.col("n_code_points")).otherwise(F.coalesce("shared", F.lit(0))).cast("long")
    return joined.select("doc_id", "n_code_points", shared.alias("shared_code_points"),
                         F.when(F.col("n_code_points") > 0, F.round(shared / F.col("n_code_points"), 6)).otherwise(F.lit(0.0)).alias("shared_share"))
