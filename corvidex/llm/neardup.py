"""Near-duplicate records with small edits (problem 4).

Method: generalised pigeonhole over sparse binary vectors. A text's bits are
its distinct word sequences of length n. Jaccard >= t means that of a text's a
bits at most D = a - ceil(t a) are missing in the other text.

* Partitions and thresholds. Cut a text's bits into any partitions (sequences
  that overlap in the text are correlated and fall together) and give partition
  g a threshold r_g from -1 up, such that the sum of r_g + 1 exceeds D. Then
  some partition misses at most r_g bits in the other text, so among any r_g + 1
  bits of it one is common: those are probed.
* Allocation. Probing r + 1 bits of a partition costs the candidates of its
  r + 1 rarest bits. A dynamic program over partitions minimises the sum; as a
  partition's next unit never costs less than the one before, its optimum takes
  the cheapest units of all partitions in order, whatever the partitions are
  (tests compare it with the program itself). ``allocate`` does that for whole
  batches. D + 1 units suit partners of any size; with one of like size more bits
  must be common, and as many hits as the units then exceed need, HITS at most,
  are asked of a pair.
* Counts are estimated once from all texts; the frequent ones are kept in a
  summary of bounded size that every text shares, so that both sides of a pair
  take their units in one order, and each need only probe its own.
* Probe and verify. Texts that share enough probed bits, fit in size and can
  still reach the overlap from their positions on are verified exactly. A bit
  estimated to be in over BLOCK texts is probed in blocks: one side is cut up,
  the other goes to every block.

Exact copies are one class from the start (64-bit digest of the text: of a
thousand million texts two differing ones fall together with a chance of a few
per cent), so a group of copies of any size costs as much as one text per task
that meets it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .pairs import components, expand_pairs
from .words import WordHashes, mix64, ngram_hashes, word_hashes, words

FREQUENT = 262_144
HITS = 4
BLOCK = 20_000
_BUFFER = 1 << 21


def sequences(texts: list[str], n: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts at once: word hashes, n-word hashes (those across two texts included), words of each text."""
    tokens = [words(t) for t in texts]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    h = np.fromiter(map(cache.__getitem__, chain.from_iterable(tokens)), np.uint64, int(lengths.sum()))
    return h, ngram_hashes(h, n), lengths


def signed(texts: list[str], n: int, least: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(bits, number of the text of each), bits of a text may repeat; none of texts under ``least`` words."""
    _, g, lengths = sequences(texts, n, cache)
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(texts)), lengths)[: len(g)]
    inside = np.arange(len(g)) + n <= (starts + lengths)[of]
    inside &= (lengths >= least)[of]
    return g[inside], of[inside]


def ordered(sig: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signatures renamed so that their natural order is the shared one: first by estimated count, in steps of a fifth, then by hash."""
    cost = np.zeros(len(sig), np.int64)
    if len(keys):
        at = np.searchsorted(keys, sig.view(np.int64))
        at[at == len(keys)] = 0
        cost = np.where(keys[at] == sig.view(np.int64), counts[at], 0)
    step = np.minimum(np.log1p(cost) / np.log(1.2), 127).astype(np.uint64)
    return (step << np.uint64(56)) | (sig >> np.uint64(8))


def allocate(name: np.ndarray, of: np.ndarray, texts: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest units of each text: (name, text, place in the shared order, bits of the text)."""
    order = np.lexsort((name, of))
    name, of = name[order], of[order]
    if len(name):
        new = np.concatenate(([True], (name[1:] != name[:-1]) | (of[1:] != of[:-1])))
        name, of = name[new], of[new]
    held = np.bincount(of, minlength=texts)
    units = held - np.ceil(threshold * held - 1e-9).astype(np.int64) + 1
    place = np.arange(len(of)) - (np.cumsum(held) - held)[of]
    keep = place < units[of]
    return name[keep], of[keep], place[keep], held[of[keep]]


def in_blocks(name, cls, size, place, role, is_hot: np.ndarray, blocks: dict[int, int]):
    """Probes of hot bits, cut into blocks: as x (role 1) a text stands in one block of its bit, as y (role 2) in all of them."""
    at = np.flatnonzero(is_hot)
    n = np.fromiter((blocks[x] for x in name[at].tolist()), np.int64, len(at))
    own = (mix64(cls[at].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
    every = np.repeat(at, n)
    block = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
    cold = np.flatnonzero(~is_hot)
    rows = np.concatenate((cold, at, every))
    part = np.concatenate((np.zeros(len(cold), np.int64), own + 1, block + 1)).astype(np.uint64)
    role = np.concatenate((role[cold], np.full(len(at), 1, np.int8), np.full(len(every), 2, np.int8)))
    with np.errstate(over="ignore"):
        moved = np.where(part > 0, mix64(name[rows] + part * np.uint64(0x9E3779B97F4A7C15)), name[rows])
    return moved, cls[rows], size[rows], place[rows], role


def _frequent(rows: DataFrame, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent bits of all texts with their counts; tasks keep at most FREQUENT each between buffers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, parts, held = WordHashes(), [], 0
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def fold() -> None:
            nonlocal keys, counts, parts, held
            k = np.concatenate([keys, *parts])
            w = np.concatenate([counts, np.ones(len(k) - len(keys), np.int64)])
            keys, back = np.unique(k, return_inverse=True)
            counts = np.bincount(back, w).astype(np.int64)
            if len(keys) > FREQUENT:
                top = np.sort(np.argpartition(counts, -FREQUENT)[-FREQUENT:])
                keys, counts = keys[top], counts[top]
            parts, held = [], 0

        for batch in batches:
            parts.append(signed(batch.column(0).to_pylist(), n, min_words, cache)[0])
            held += len(parts[-1])
            if held >= _BUFFER:
                fold()
        if parts:
            fold()
        some = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[some])], names=["sig", "n"])

    found = rows.select("text").mapInArrow(count, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "sig").limit(FREQUENT).toArrow()
    keys, counts = top.column("sig").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def similar_classes(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pairs(cls_a, cls_b, both, either), ids(cls, id)) of texts with Jaccard >= threshold.

    A class holds the rows of one text, named by its digest. Rows with a null id
    or text, and texts of fewer than ``min_words`` (or n) words, make no
    pair, though ids names them. Rows repeated whole count once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0")
    rows = rows.withColumn("cls", F.xxhash64("text"))
    table = spark.sparkContext.broadcast(_frequent(rows, n, min_words))  # at most FREQUENT entries

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = table.value
        cache, seen = WordHashes(), set()
        names = ordered(keys.view(np.uint64), keys, counts)
        hot = counts > BLOCK
        blocks = dict(zip(names[hot].tolist(), np.ceil(counts[hot] / BLOCK).astype(int).tolist()))
        hot_names = np.sort(names[hot])
        for batch in batches:
            new = {}
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if cls not in seen:
                    new[cls] = text
            if len(seen) < 1_000_000:
                seen.update(new)
            sig, of = signed(list(new.values()), n, min_words, cache)
            name, of, place, size = allocate(ordered(sig, keys, counts), of, len(new), threshold)
            cls = np.fromiter(new, np.int64, len(new))[of]
            role = np.full(len(name), 3, np.int8)
            if len(hot_names) and (is_hot := hot_names[np.minimum(np.searchsorted(hot_names, name), len(hot_names) - 1)] == name).any():
                name, cls, size, place, role = in_blocks(name, cls, size, place, role, is_hot, blocks)
            for s in range(0, len(name), 500_000):
                e = slice(s, s + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(name[e].view(np.int64)), pa.array(cls[e]), pa.array(size[e].astype(np.int32)), pa.array(place[e].astype(np.int32)), pa.array(role[e])], names=["sig", "cls", "size", "place", "role"])

    probes = rows.select("cls", "text").mapInArrow(emit, "sig long, cls long, size int, place int, role byte")
    probes = probes.repartition("sig").dropDuplicates(["sig", "cls", "role"])
    # x is the smaller text (ties: the smaller digest). A pair of a and b bits needs ``overlap`` common ones; of those,
    # ``k`` stand among the first size - overlap + k of either text, as the probed bits of both stand in one order.
    t = F.lit(threshold)
    fits = ((F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.cls") < F.col("y.cls")))) & (F.col("x.size") >= t * F.col("y.size") - 1e-9)
    overlap = F.ceil(t / (1 + t) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    spare = [overlap - F.ceil(t * F.col(f"{side}.size") - 1e-9) + 1 for side in "xy"]
    k = F.least(F.lit(HITS), overlap, *spare)
    fits &= (F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) > overlap - k) 
    # of both sides at once, as a condition on one would part the two scans of the probes
    fits &= F.col("x.role").bitwiseAND(F.lit(1)) * F.shiftright(F.col("y.role").cast("int"), 1) > 0
    ties = (
        probes.alias("x").join(probes.alias("y"), (F.col("x.sig") == F.col("y.sig")) & fits)
        .groupBy(F.col("x.cls").alias("cls_a"), F.col("y.cls").alias("cls_b"))
        .agg(F.count(F.lit(1)).alias("hits"), F.first(k).alias("k")).where("hits >= k").select("cls_a", "cls_b")
    )
    ties = materialize(ties, "neardup-ties")
    wanted = ties.select(F.col("cls_a").alias("cls")).unionByName(ties.select(F.col("cls_b").alias("cls"))).distinct()
    texts = rows.select("cls", "text").join(small(wanted), "cls", "left_semi").dropDuplicates(["cls"])
    texts = materialize(texts, "neardup-texts")
    both = ties.join(texts.select(F.col("cls").alias("cls_a"), F.col("text").alias("text_a")), "cls_a")
    both = both.join(texts.select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b")), "cls_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, memo = WordHashes(), {}

        def bits(cls: int, text: str) -> np.ndarray:
            if cls not in memo:
                if len(memo) >= 2_000:
                    memo.clear()
                memo[cls] = np.unique(ngram_hashes(word_hashes(words(text), cache), n))
            return memo[cls]

        for batch in batches:
            ca, cb, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            common, either = np.zeros(len(ca), np.int32), np.zeros(len(ca), np.int32)
            for i in range(len(ca)):
                a, b = bits(ca[i], ta[i]), bits(cb[i], tb[i])
                common[i] = len(np.intersect1d(a, b, assume_unique=True))
                either[i] = len(a) + len(b) - common[i]
            ok = common >= threshold * either - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ca, np.int64)[ok]), pa.array(np.array(cb, np.int64)[ok]), pa.array(common[ok]), pa.array(either[ok])], names=["cls_a", "cls_b", "both", "either"])

    pairs = both.select("cls_a", "cls_b", "text_a", "text_b").mapInArrow(verify, "cls_a long, cls_b long, both int, either int")

    return pairs, rows.select("cls", "id").distinct()


def small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``df`` of one or two longs a row, to be broadcast if it has at most ``limit`` rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _members(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id is not null").where(has_words("text", 20)).select(F.xxhash64("text").alias("cls"), F.col("chunk_id").cast("long").alias("id")).distinct()


def has_words(text: str, least: int) -> Column:
    return F.regexp_count(F.col(text), F.lit(r"[\p{L}\p{N}]+")) >= least


def p4_found(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    chunks = table(spark, sf_dir, "chunks")
    pairs, ids = similar_classes(chunks, "chunk_id", "text", n=3, threshold=0.5, min_words=20)
    pairs = materialize(pairs, "neardup-pairs")
    copies = ids.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    texts = chunks.select(F.xxhash64("text").alias("cls"), "text").where("length(text) > 0").join(small(copies), "cls", "left_semi")
    long = materialize(texts.where(has_words("text", 20)).select("cls").distinct(), "neardup-copies")
    named = long.unionByName(pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls"))).distinct()
    members = materialize(ids.join(small(named), "cls", "left_semi"), "neardup-members")
    heads = members.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    several = members.join(heads.where("n > 1"), "cls").select("rep", "id", "n")
    out = pairs.join(heads.select(F.col("cls").alias("cls_a"), F.col("rep").alias("a")), "cls_a")
    out = out.join(heads.select(F.col("cls").alias("cls_b"), F.col("rep").alias("b")), "cls_b")
    return expand_pairs(out.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b")), several, "chunk_a", "chunk_b")


def p4_classes(spark, sf_dir: str) -> DataFrame:
    """Each chunk of at least 20 words with its class of equal texts (smallest chunk_id), its path and its number of links.

    ``links`` counts the classes similar to the chunk's class and the other
    members of that class; chunks without any have 0.
    """
    from ..session import table

    chunks = table(spark, sf_dir, "chunks")
    pairs, _ = similar_classes(chunks, "chunk_id", "text", n=3, threshold=0.5, min_words=20)
    members = materialize(_members(chunks), "neardup-members")
    heads = members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    ends = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("near"))
    paths = chunks.groupBy(F.col("chunk_id").cast("long").alias("id")).agg(F.max("doc_path").alias("doc_path"))
    out = members.join(heads, "cls").join(ends, "cls", "left").join(paths, "id", "left")
    return out.select(F.col("id").alias("chunk_id"), "doc_path", "class_id", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"))


def p4_groups(spark, sf_dir: str) -> DataFrame:
    """Each chunk of at least 20 words with its group: chunks tied by a chain of similar or equal texts, named by the smallest chunk_id.

    ``group_size`` counts the chunks of the group; a chunk tied to none is a group of one.
    """
    from ..session import table

    chunks = table(spark, sf_dir, "chunks")
    pairs, _ = similar_classes(chunks, "chunk_id", "text", n=3, threshold=0.5, min_words=20)
    members = materialize(_members(chunks), "neardup-members")
    heads = members.groupBy("cls").agg(F.min("id").alias("rep"))
    ends = pairs.join(heads.select(F.col("cls").alias("cls_a"), F.col("rep").alias("a")), "cls_a").join(heads.select(F.col("cls").alias("cls_b"), F.col("rep").alias("b")), "cls_b")
    roots = components(ends.select("a", "b"))
    out = members.join(heads, "cls").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("group_id"))
    out = materialize(out, "neardup-groups")
    sizes = out.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    paths = chunks.groupBy(F.col("chunk_id").cast("long").alias("id")).agg(F.max("doc_path").alias("doc_path"))
    return out.join(sizes, "group_id").join(paths, "id", "left").select(F.col("id").alias("chunk_id"), "doc_path", "group_id", "group_size")
