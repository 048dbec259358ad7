"""Mixing sources to target weights (problem 7).

Method: capped water-filling. A source may give at most max_repeats times its
tokens. Sources whose target exceeds that are clamped, what they cannot give is
spread over the others in proportion to their targets, and so on until nothing
is over its cap. Each document is then taken floor(epochs) times, and a seeded
part of the documents once more for the fraction.

Sizes are tokens of a public tokenizer, counted over whole texts. Only sums per
target source reach the driver. The fractional part is cut by a hash of the id:
tokens are summed per source and hash bucket, and only the bucket in which the
cut falls is ordered, so a source of any size is never sorted in one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern that belongs to this public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The byte-level tokenizer of a ranks file, once per worker."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def source_key(source: Column) -> Column:
    """One spelling per source: lower case, trimmed, runs of blanks, ``_`` and ``-`` as one ``-``."""
    return F.regexp_replace(F.trim(F.lower(source)), r"[\s_-]+", "-")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): rows of (doc_id, source, text) with their whole text's tokens; null text has 0.

    ``vocabulary`` is a file of the driver's machine; Spark sends it to the executors.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            tokens = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(
        count, "doc_id long, source string, tokens long")


def water_fill(targets: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: min(cap, weight) with the excess of clamped sources spread over the rest in proportion."""
    given: dict[str, float] = {}
    free, left = {s: w for s, w in targets.items() if w > 0}, float(total)
    while free:
        weight = sum(free.values())
        over = [s for s, w in free.items() if left * w / weight >= caps.get(s, 0.0) - 1e-9]
        if not over:
            given |= {s: left * w / weight for s, w in free.items()}
            break
        for s in over:
            given[s] = caps.get(s, 0.0)
            del free[s]
        left = max(0.0, total - sum(given.values()))
    return {s: given.get(s, 0.0) for s in targets}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(selection(doc_id, source, repeats, tokens), report) of a mixture.

    documents: (doc_id, source, text), targets: (source, target_share,
    max_repeats). ``total_tokens`` defaults to all tokens of sources with a
    target. Sources are compared by source_key(); of a target named twice the
    shares add up and the smallest cap holds. Null sources, ids and texts, and
    sources without a target, take no part; rows repeated whole count once; null
    shares and caps count as 0. Absent sources appear in the report with 0. The
    selection differs from the shares asked for only by caps and whole documents.
    """
    spark = documents.sparkSession
    want = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(0))).cast("int").alias("max_repeats"))
    want = materialize(want, "mix-targets")
    docs = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").where("doc_id is not null and source is not null and length(text) > 0")
    sized = token_counts(docs.join(want.select("source"), "source", "left_semi"), vocabulary).distinct()
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)).cast("int")
    sized = materialize(sized.where("tokens > 0").withColumn("bucket", bucket), "mix-sizes")
    per_bucket = materialize(sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-buckets")
    have = per_bucket.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("docs").alias("docs"))

    plan = [r.asDict() for r in want.join(have, "source", "left").collect()]  # a row per target
    available = {r["source"]: float(r["available"] or 0) for r in plan}
    caps = {r["source"]: available[r["source"]] * max(0, r["max_repeats"]) for r in plan}
    total = float(total_tokens) if total_tokens is not None else sum(available.values())
    given = water_fill({r["source"]: max(0.0, r["target_share"]) for r in plan}, caps, total)
    rows = []
    for r in plan:
        tokens = available[r["source"]]
        epochs = given[r["source"]] / tokens if tokens else 0.0
        whole = int(epochs + 1e-9)
        rows.append((r["source"], whole, max(0.0, epochs - whole) * tokens))
    quota = spark.createDataFrame(rows, "source string, whole int, extra double")

    # the bucket in which each source's fraction ends; all before it are taken once more
    before = F.expr("coalesce(sum(tokens) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0)")
    edge = per_bucket.withColumn("before", before).join(F.broadcast(quota), "source")
    edge = materialize(edge.where("before < extra").groupBy("source", "whole", "extra").agg(F.max(F.struct("bucket", "before")).alias("m")).select("source", "extra", "m.bucket", "m.before"), "mix-edges")
    joined = sized.join(F.broadcast(quota.select("source", "whole")), "source").join(
        F.broadcast(edge.select("source", "extra", F.col("bucket").alias("last"), "before")), "source", "left")
    clear = joined.where("last is null or bucket <> last").select("doc_id", "source", "tokens", (F.col("whole") + (F.coalesce(F.col("bucket") < F.col("last"), F.lit(False))).cast("int")).alias("repeats"))
    inside = joined.where("bucket = last").withColumn("run", F.expr("before + sum(tokens) over (partition by source order by xxhash64(doc_id), doc_id)"))
    # the document that crosses the quota is taken if most of it fits
    cut = inside.select("doc_id", "source", "tokens", (F.col("whole") + (F.col("run") - F.col("tokens") / 2 <= F.col("extra")).cast("int")).alias("repeats"))
    selection = clear.unionByName(cut).where("repeats > 0").select("doc_id", "source", "repeats", "tokens")

    taken = selection.groupBy("source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("chosen"), F.count(F.lit(1)).alias("documents"))
    every = F.sum("chosen_tokens").over(_all())
    report = want.join(have.select("source", "available"), "source", "left").join(taken, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chosen", F.lit(0)).alias("chosen_tokens"))
    report = report.withColumn("actual_share", F.when(every > 0, F.col("chosen_tokens") / every).otherwise(0.0))
    return selection, report


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # a row per target


def p7_selection(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, how often the document is taken, and its tokens."""
    from ..session import table

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark, sf_dir: str) -> DataFrame:
    """Target and actual share of every source in mix_targets."""
    from ..session import table

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
