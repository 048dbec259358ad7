"""Cosine retrieval over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, width: int) -> Column:
    return (F.size(vector) == width) & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def distances(vectors: DataFrame, query: list[float], keep: list[str], vector_col: str = "embedding", best: int | None = None) -> DataFrame:
    """(keep.., distance): 1 - cosine to a query in double precision, over Arrow batches; vectors that are not usable drop out.

    With ``best``, each partition gives only the rows of its ``best`` nearest
    distinct values of the first kept column (ties: the smaller value).
    """
    q = np.array(query, np.float64)
    q_norm = float(np.sqrt(q @ q))
    width = len(q)
    rows = vectors.select(*keep, F.col(vector_col).cast("array<float>").alias("v")).where(F.size("v") == width)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", distance double"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            flat = batch.column(len(keep)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            norm = np.sqrt(np.einsum("bd,bd->b", x, x))
            ok = np.isfinite(norm) & (norm > 0)
            with np.errstate(all="ignore"):
                d = np.round(1.0 - np.einsum("bd,d->b", x, q) / (norm * q_norm), 12)  # equal vectors tie
            some = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(d)], names=[*keep, "distance"]).filter(pa.array(ok))
            if best is None:
                yield some
                continue
            t = pa.Table.from_batches([some]) if held is None else pa.concat_tables([held, pa.Table.from_batches([some])])
            ids, dist = t.column(0).to_numpy(zero_copy_only=False), t.column("distance").to_numpy()
            order = np.lexsort((ids, dist))
            first = np.sort(np.unique(ids[order], return_index=True)[1])[:best]
            held = t.take(pa.array(order[first])).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(measure, schema)


def knn(vectors: DataFrame, query: list[float], id_col: str = "chunk_id", vector_col: str = "embedding", allowed: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(id_col, distance) of the usable vectors, repeated rows once; with ``k`` the nearest k only, cut in every partition before any shuffle.

    Order with orderBy(distance, id). ``allowed`` (id_col) restricts the rows.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select(id_col).distinct(), id_col, "left_semi")
    found = distances(vectors, query, [id_col], vector_col, k).groupBy(id_col).agg(F.min("distance").alias("distance"))
    return found if k is None else found.orderBy("distance", id_col).limit(k)


def centroids(vectors: DataFrame, key: str, width: int, vector_col: str = "embedding") -> DataFrame:
    """(key, pos, value): the element-wise mean per key, in double precision."""
    rows = vectors.where(usable(F.col(vector_col), width)).select(key, F.posexplode(vector_col).alias("pos", "x"))
    return rows.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_of(vectors: DataFrame, width: int, vector_col: str = "embedding") -> list[float] | None:
    """The mean of a frame's usable vectors as a literal (``width`` numbers), None without any."""
    row = vectors.where(usable(F.col(vector_col), width)).agg(*[F.avg(F.col(vector_col)[i].cast("double")).alias(f"v{i}") for i in range(width)]).first()
    return None if row is None or row[0] is None else list(row)


def similar_documents(vectors: DataFrame, path: str, width: int = 64, embedding: str = "embedding") -> DataFrame:
    """(doc_path, distance) of every other document: its nearest chunk's distance to the mean vector of ``path``."""
    own = vectors.where(F.col("doc_path") == path).dropDuplicates(["chunk_id"])
    centre = centroid_of(own, width, embedding)
    if centre is None:
        return vectors.sparkSession.createDataFrame([], "doc_path string, distance double")
    return distances(vectors.where(F.col("doc_path") != path), centre, ["doc_path"], embedding).groupBy("doc_path").agg(F.min("distance").alias("distance"))


def better_of(first: DataFrame, second: DataFrame) -> DataFrame:
    """Of two (.., distance) lists the one whose best distance is strictly smaller; the first wins ties and against an empty one."""
    a = first.agg(F.min("distance")).first()[0]
    b = second.agg(F.min("distance")).first()[0]
    return second if b is not None and (a is None or b < a) else first
