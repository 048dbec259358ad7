"""Classes of exact copies, and pairs of classes written out as pairs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _digested(df: DataFrame, id_col: str, text_col: str, keep: Column | None) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    if keep is not None:
        rows = rows.where(keep)
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def class_members(df: DataFrame, id_col: str, text_col: str, keep: Column | None = None, least: int = 1) -> DataFrame:
    """(rep, id, n, length): each id with its class of at least ``least`` equal texts, their number and the text's length."""
    ids = _digested(df, id_col, text_col, keep).select("digest", "id", F.length("text").alias("length")).distinct()
    heads = ids.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return ids.join(heads, "digest").select("rep", "id", "n", "length")


def copy_classes(df: DataFrame, id_col: str, text_col: str, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(representatives(rep, text), members(rep, id, n, length)) of the rows with equal text.

    The representative is the smallest id. Rows whose text or id is null take no
    part; members are those of classes of two or more. Only (digest, id) pairs
    are aggregated map-side; the text of a class travels once per map task, not
    once per copy.
    """
    rows = _digested(df, id_col, text_col, keep)
    reps = rows.groupBy("digest").agg(F.min("id").alias("rep"), F.first("text").alias("text")).select("rep", "text")
    return reps, class_members(df, id_col, text_col, keep, 2)


def expand_pairs(pairs: DataFrame, members: DataFrame, a: str, b: str, class_limit: int = 1000) -> DataFrame:
    """Pairs of ids (a < b) from pairs of representatives plus the classes of copies.

    ``pairs`` has (a, b) of representatives; ``members`` lists classes of two or
    more copies. Classes of up to ``class_limit`` copies are written out in full.
    A larger class gives a star: each copy with the representative, and across
    classes each member with the other representative. No link between
    different texts is lost; the rest follows from the membership.
    """
    small = F.col("n") <= class_limit
    inside = (
        members.where(small).select("rep", F.col("id").alias("x"))
        .join(members.where(small).select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    ).unionByName(members.where(~small).where("rep <> id").select(F.col("rep").alias("x"), F.col("id").alias("y")))
    heads = members.where("rep = id").select("rep", "n")
    one = F.coalesce(F.col("n"), F.lit(1))
    sized = pairs.select(F.col(a).alias("ra"), F.col(b).alias("rb"))
    for side in ("a", "b"):
        sized = sized.join(heads.withColumnRenamed("rep", f"r{side}"), f"r{side}", "left").withColumn(f"n{side}", one).drop("n")
    sized = sized.withColumn("star", F.greatest("na", "nb") > class_limit)
    left = sized.join(members.select(F.col("rep").alias("ra"), F.col("id").alias("ia")), "ra", "left").withColumn("x", F.coalesce("ia", "ra"))
    # a star's second half starts from its representative alone, before the other class is written out
    both = left.where("not star or x = ra").join(members.select(F.col("rep").alias("rb"), F.col("id").alias("ib")), "rb", "left").select("x", F.coalesce("ib", "rb").alias("y"))
    across = both.unionByName(left.where("star").select("x", F.col("rb").alias("y")))
    every = across.unionByName(inside)
    return every.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node its chain of edges reaches.

    Alternates large and small stars (Kiveris et al., 2014): every round hangs a
    node's neighbours onto its smallest one, until nothing moves. Each round is
    written to the shared folder; rounds grow with the logarithm of the nodes.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "component-edges")

    def star(e: DataFrame, both_ways: bool) -> DataFrame:
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else e
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        hung = around.join(least, "u")
        if both_ways:  # larger neighbours onto the smallest
            return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    while True:
        after = materialize(star(star(now, True), False), "component-edges")
        same = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
