"""Most similar vectors for every vector (problem 2).

Method: balanced posting lists, as many as the table needs (one for ``list_rows``
vectors, MAX_LISTS at most). Centroids are fitted on a sample of SAMPLED vectors
a list, in two levels: a few coarse cells on the driver, then each cell in the
cluster, by splitting clusters until they are about equally large; the coarse
fit sees COARSE vectors however large the table. Every vector is posted
to its nearest list and, near a boundary, to further lists whose centroid is
not much farther (closure); every vector then queries the lists whose centroid
distance is within a ratio of the nearest one (pruning), and the hits of its
lists are merged. Centroids are found by walking a graph held in memory: from the
nearest of a few entries along edges to near centroids, until the best stay.

All rows are indexed and all rows are queried, in one shuffle on the list.
Lists expected to outgrow ``cell_rows`` are cut into a grid of cells (blocks of
postings times blocks of queries), so no task holds a whole hot list. Equal
vectors are one entry with their smallest ids, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SAMPLED, COARSE = 16, 16_384
MAX_LISTS = 65_536


class CentroidGraph:
    """Unit centroids as a graph: entries with edges down to near centroids, and edges between near centroids.

    search() ranks the entries, about the square root of the centroids in number,
    and follows the edges of the best; then those of the best centroids found, as
    long as that betters any of them, WALK times at most.
    """

    def __init__(self, centroids: np.ndarray, down: int = 64, degree: int = 32, wide: int = 192, seed: int = 7):
        self.c = np.ascontiguousarray(centroids, np.float32)
        k = len(self.c)
        entries = min(k, max(16, round(k**0.5)))
        rng = np.random.default_rng(seed)
        self.entry = self.c[rng.choice(k, entries, replace=False)]
        for _ in range(5):
            a = np.concatenate([np.argmax(self.c[i : i + 4096] @ self.entry.T, 1) for i in range(0, k, 4096)])
            sums = np.zeros((entries, self.c.shape[1]))
            np.add.at(sums, a, self.c)
            empty = np.sqrt((sums * sums).sum(1)) < 1e-9
            sums[empty] = self.c[rng.choice(k, int(empty.sum()))]
            self.entry = _unit(sums)
        self.down = self._near(self.entry, min(down, k), False)
        self.edges = self._spread(self._near(self.c, min(wide, k - 1), True), min(degree, k - 1)) if k > 1 else np.zeros((1, 1), np.int32)

    def _near(self, x: np.ndarray, n: int, own: bool) -> np.ndarray:
        out = []
        for i in range(0, len(x), 1024):
            s = x[i : i + 1024] @ self.c.T
            if own:
                s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
            at = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out.append(np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out).astype(np.int32)

    def _spread(self, near: np.ndarray, degree: int) -> np.ndarray:
        """Of each centroid's near ones (best first) ``degree`` in different directions: those nearer to it than to one taken before, then the nearest others."""
        out = np.empty((len(near), degree), np.int32)
        for i, cand in enumerate(near):
            y = self.c[cand]
            between, own = y @ y.T, y @ self.c[i]
            closest = np.full(len(cand), -np.inf, np.float32)
            free = np.ones(len(cand), bool)
            taken: list[int] = []
            while len(taken) < degree:
                j = int(np.argmax(free & (own > closest)))
                if not (free[j] and own[j] > closest[j]):
                    break
                taken.append(j)
                free[j] = False
                closest = np.maximum(closest, between[:, j])
            out[i] = cand[(taken + np.flatnonzero(free).tolist())[:degree]]
        return out

    def _rank(self, x: np.ndarray, cand: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        if cand.shape[1] < top:
            cand = np.tile(cand, (1, -(-top // cand.shape[1])))
        cand = np.sort(cand, axis=1)
        s = np.einsum("bd,bkd->bk", x, self.c[cand], optimize=False)
        s[:, 1:][cand[:, 1:] == cand[:, :-1]] = -9
        at = np.argpartition(-s, top - 1, axis=1)[:, :top]
        v = np.take_along_axis(s, at, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        return np.take_along_axis(np.take_along_axis(cand, at, 1), order, 1), np.take_along_axis(v, order, 1)

    def search(self, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, cosines), best first; fewer distinct ones than asked repeat with cosine -9."""
        ids, cos = [], []
        beam = max(top, BEAM)
        for i in range(0, len(x), 1024):
            b = x[i : i + 1024]
            s = b @ self.entry.T
            start = min(STARTS, s.shape[1])
            first = np.argpartition(-s, start - 1, axis=1)[:, :start]
            best, v = self._rank(b, self.down[first].reshape(len(b), -1), beam)
            walking = np.arange(len(b))
            for _ in range(WALK):
                now = best[walking]
                found, near = self._rank(b[walking], np.concatenate([now, self.edges[now[:, :EXPANDED]].reshape(len(now), -1)], axis=1), beam)
                moved = (found[:, :top] != now[:, :top]).any(1)
                best[walking], v[walking] = found, near
                walking = walking[moved]
                if not len(walking):
                    break
            ids.append(best[:, :top])
            cos.append(v[:, :top])
        return np.concatenate(ids), np.concatenate(cos)


STARTS, BEAM, EXPANDED, WALK = 10, 16, 8, 5


def _unit(x: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64)
    return (d / np.sqrt((d * d).sum(1, keepdims=True))).astype(np.float32)


def balanced_centroids(x: np.ndarray, k: int, seed: int = 7, rounds: int = 6) -> np.ndarray:
    """About k unit centroids of the unit rows x: the largest cluster is split in two until there are k, then refined."""
    rng = np.random.default_rng(seed)
    parts, done = [np.arange(len(x))], []
    share = max(1, len(x) // k)
    while parts:
        at = parts.pop()
        pieces = min(64, round(len(at) / share))
        if pieces < 2:
            done.append(at)
            continue
        y = x[at]
        c = y[rng.choice(len(y), pieces, replace=False)]
        penalty = np.zeros(pieces, np.float32)
        for _ in range(rounds):
            a = np.argmax(y @ c.T - penalty, axis=1)
            n = np.bincount(a, minlength=pieces)
            penalty = np.maximum(0, penalty + 0.02 * (n / (len(y) / pieces) - 1)).astype(np.float32).clip(0, 0.1)
            sums = np.zeros_like(c, np.float64)
            np.add.at(sums, a, y)
            empty = np.sqrt((sums * sums).sum(1)) < 1e-9
            sums[empty] = y[rng.choice(len(y), int(empty.sum()))]
            c = _unit(sums)
        a = np.argmax(y @ c.T, axis=1)
        if (np.bincount(a, minlength=pieces) == len(y)).any():  # equal rows do not part
            done.append(at)
            continue
        for j in range(pieces):
            if (mine := at[a == j]).size:
                (parts if len(mine) > 1.5 * share and pieces < len(at) else done).append(mine)
    sums = np.stack([x[at].astype(np.float64).sum(0) for at in done])
    keep = np.sqrt((sums * sums).sum(1)) > 1e-9
    return _unit(sums[keep]) if keep.any() else x[:1]


def fitted(rows: DataFrame, total: int, lists: int, sampled: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the coarse sample, about ``lists`` unit centroids) for rows (id, vec, h); samples are by hash, so a run that is repeated takes the same."""
    spark = rows.sparkSession
    scale = 1 << 30
    share = F.pmod(F.xxhash64("h", "id"), F.lit(scale))
    some = rows.where(share < min(scale, -(-scale * lists * sampled // total)))
    coarse = rows.where(share < min(scale, -(-scale * COARSE // total))).select("vec").toArrow()  # about COARSE rows
    if not coarse.num_rows:
        coarse = rows.select("vec").limit(COARSE).toArrow()
    x = _unit(_matrix(coarse.column("vec"), width))
    cells = balanced_centroids(x, max(1, min(round(lists**0.5), len(x) // 64)))
    shared = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unit(_matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(v @ shared.value.T, 1).astype(np.int32)), batch.column(0)], names=["cell", "vec"])

    n_sample = min(total, lists * sampled)

    def split(group: pa.Table) -> pa.Table:
        v = _unit(_matrix(group.column("vec"), width))
        return pa.table({"vec": _binary(balanced_centroids(v, max(1, round(lists * len(v) / n_sample))))})

    # a cell holds the sample's size over the cells, about SAMPLED times the root of the lists
    found = some.select("vec").mapInArrow(place, "cell int, vec binary").groupBy("cell").applyInArrow(split, "vec binary").toArrow()  # at most about MAX_LISTS
    return x, (_matrix(found.column("vec"), width) if found.num_rows else cells)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = np.frombuffer(column.buffers()[2], np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.float32).reshape(len(column), width) if len(column) else np.empty((0, width), np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * 4
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())])


def most_similar(
    vectors: DataFrame, id_col: str, vector_col: str, width: int = 64, k: int = 5,
    list_rows: int = 256, post_lists: int = 4, query_lists: int = 6, post_ratio: float = 1.2, query_ratio: float = 1.3,
    sampled: int = SAMPLED, max_lists: int = MAX_LISTS, cell_rows: int = 8_192,
) -> DataFrame:
    """(id, other, similarity, place): for every vector its k most similar ones, place 1 to k.

    Similarity is the cosine in double precision; ties rank by the smaller id.
    Vectors that are null, not ``width`` wide, hold a null, NaN or infinity, or
    are all zero take no part; rows repeated whole count once. With k or fewer
    vectors each gets all others. Tables without such a vector give no rows.
    """
    spark = vectors.sparkSession
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            ok = np.ones(len(batch), bool)
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float32) if len(flat) else np.empty((0, width), np.float32)
            norm = np.einsum("bd,bd->b", x.astype(np.float64), x.astype(np.float64))
            ok = np.isfinite(norm) & (norm > 0)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[ok]), _binary(x[ok])], names=["id", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        (F.size("v") == width) & F.col("id").isNotNull())
    rows = materialize(rows.mapInArrow(parse, "id long, vec binary").withColumn("h", F.xxhash64("vec")), "knn-rows")
    # copies: of each vector the smallest id stands for all, with the k + 1 smallest ids
    ids = rows.select("h", "id").distinct()
    heads = ids.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1")
    copies = materialize(ids.join(heads, "h").select("id", "rep", "n"), "knn-copies")
    others = copies.where("id <> rep").select("id")
    if copies.limit(1).count():
        lone = rows.join(F.broadcast(others) if others.limit(1_000_001).count() <= 1_000_000 else others, "id", "left_anti")
    else:
        lone = rows

    total = lone.count()
    if not total:
        return spark.createDataFrame([], "id long, other long, similarity double, place int")
    lists = int(max(1, min(max_lists, total // list_rows)))
    x, centroids = fitted(lone, total, lists, sampled, width)
    graph = CentroidGraph(centroids)
    nearest = graph.search(x, 1)[0][:, 0]
    expected = np.bincount(nearest, minlength=len(centroids)) * (total / len(x)) * 2.5
    blocks = np.maximum(1, np.ceil(expected / cell_rows)).astype(np.int64)
    index = spark.sparkContext.broadcast((graph, blocks))  # at most max_lists centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, blocks = index.value
        for batch in batches:
            v, i = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            if not len(v):
                continue
            near, cos = graph.search(_unit(v), max(post_lists, query_lists))
            dist = np.sqrt(np.maximum(0, 2 - 2 * cos))
            real = cos > -2
            post, query = real & (dist <= dist[:, :1] * post_ratio + 1e-6), real & (dist <= dist[:, :1] * query_ratio + 1e-6)
            post[:, post_lists:] = False
            query[:, query_lists:] = False
            r, c = np.nonzero(post | query)
            cells, role = near[r, c].astype(np.int64), post[r, c] + 2 * query[r, c]
            n = blocks[cells]
            if (n == 1).all():
                yield pa.RecordBatch.from_arrays([pa.array(cells << 32), pa.array(i[r]), pa.array(role.astype(np.int8)), _binary(v[r])], names=["cell", "id", "role", "vec"])
                continue
            h = (i[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
            at, cell, part = [], [], []
            for bit in (1, 2):  # a posting goes to its row of the grid, a query to its column
                has = np.flatnonzero(role & bit)
                rep = np.repeat(has, n[has])
                step = np.arange(len(rep)) - np.repeat(np.cumsum(n[has]) - n[has], n[has])
                p, q = (h[rep], step) if bit == 1 else (step, h[rep])
                at.append(rep)
                cell.append((cells[rep] << 32) | (p << 16) | q)
                part.append(np.full(len(rep), bit, np.int8))
            at, cell, part = map(np.concatenate, (at, cell, part))
            for s in range(0, len(at), 20_000):
                e = slice(s, s + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(cell[e]), pa.array(i[r[at[e]]]), pa.array(part[e]), _binary(v[r[at[e]]])], names=["cell", "id", "role", "vec"])

    def scan(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        role = group.column("role").to_numpy()
        v = _matrix(group.column("vec"), width)
        u = _unit(v)
        p, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        p, q = p[np.unique(ids[p], return_index=True)[1]], q[np.unique(ids[q], return_index=True)[1]]  # repeated rows
        out = ([], [], [])
        if len(p) and len(q):
            posted, wide = np.ascontiguousarray(u[p]), v.astype(np.float64)
            norm = np.sqrt((wide * wide).sum(1))
            m = min(len(p), k + 4)
            for s in range(0, len(q), 1024):
                b = q[s : s + 1024]
                sim = u[b] @ posted.T
                best = np.argpartition(-sim, m - 1, axis=1)[:, :m] if m < len(p) else np.broadcast_to(np.arange(len(p)), sim.shape)
                a, o = np.repeat(b, m), p[best.ravel()]
                exact = np.einsum("nd,nd->n", wide[a], wide[o]) / (norm[a] * norm[o])
                keep = ids[a] != ids[o]
                a, o, exact = ids[a[keep]], ids[o[keep]], exact[keep]
                order = np.lexsort((o, -exact, a))
                a, o, exact = a[order], o[order], exact[order]
                first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.empty(0, bool)
                starts = np.flatnonzero(first)
                rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(a)]))))
                for acc, val in zip(out, (a, o, exact)):
                    acc.append(val[rank < k])
        cat = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table({"id": cat[0], "other": cat[1], "similarity": cat[2]})

    hits = lone.select("id", "vec").mapInArrow(assign, "cell long, id long, role byte, vec binary").groupBy("cell").applyInArrow(scan, "id long, other long, similarity double")
    hits = hits.repartition("id").dropDuplicates(["id", "other"])
    hits = _with_copies(hits, copies, k) if copies.limit(1).count() else hits
    rank = F.expr("row_number() over (partition by id order by similarity desc, other)")
    return hits.withColumn("place", rank).where(F.col("place") <= k).select("id", "other", "similarity", "place")


def _with_copies(hits: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Hits between representatives, written out for the copies: a copy sees the k + 1 smallest ids of each class at most."""
    some = copies.withColumn("r", F.expr("row_number() over (partition by rep order by id)")).where(F.col("r") <= k + 1)
    to = some.select(F.col("rep").alias("other"), F.col("id").alias("member"))
    wide = hits.join(to, "other", "left").select("id", F.coalesce("member", "other").alias("other"), "similarity")
    # only the best k of a representative, so that the copies multiply no more than their own result
    best = wide.withColumn("p", F.expr("row_number() over (partition by id order by similarity desc, other)")).where(F.col("p") <= k).drop("p")
    own = copies.select(F.col("rep").alias("id"), F.col("id").alias("copy"))
    spread = best.join(own, "id", "left").select(F.coalesce("copy", "id").alias("id"), "other", "similarity")
    same = copies.select("id", "rep").join(some.select("rep", F.col("id").alias("other")), "rep").where("id <> other").select("id", "other", F.lit(1.0).alias("similarity"))
    return spread.unionByName(same)


def p2_neighbours(spark, sf_dir: str) -> DataFrame:
    """chunk_id, neighbour, similarity and place (1 to 5) for every chunk with a usable embedding."""
    from ..session import table

    out = most_similar(table(spark, sf_dir, "vec_chunks"), "chunk_id", "embedding")
    return out.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour"), "similarity", "place")


def p2_found(spark, sf_dir: str) -> DataFrame:
    near = p2_neighbours(spark, sf_dir)
    a, b = F.col("chunk_id"), F.col("neighbour")
    return near.select(F.least(a, b).alias("chunk_a"), F.greatest(a, b).alias("chunk_b")).distinct()
