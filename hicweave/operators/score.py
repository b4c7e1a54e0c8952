"""Scores of pairs of contig ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_div, half, transposed
from .contacts import canonical, inter
from .tables import met, settled


def triangle(contacts: DataFrame, contigs: DataFrame, dense: DataFrame, bin_size: int, size: int) -> DataFrame:
    """x, y, code, score: weighted contacts between ends of two contigs, over cells whose ranks sum to less than size.

    Each contig brings the ranks of its dense bins, by bin from either end, so that a contact that lies in no such cell is
    left where it is met. The others are counted by their ranks from all four ends at once, before they are told apart by
    ends and meet the weights: joins see cells and not contacts. A pair of neighbours with very many contacts is shrunk by
    the partial counts.
    """
    dense = dense.filter((F.col("rank") < size) & (F.col("bin") < 10 * size))
    by_bin = dense.groupBy("contig", "e").agg(F.map_from_entries(F.collect_list(F.struct("bin", "rank"))).alias("m"), F.max("bin").alias("last"))
    ranks = by_bin.select("contig", "e", F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda b: F.try_element_at("m", b)).alias("r"))
    of = lambda e: F.max(F.when(F.col("e") == e, F.col("r")))
    near = settled(contigs.select("contig", "len").join(ranks.groupBy("contig").agg(of(0).alias("s"), of(1).alias("e")), "contig"), "near")
    c = canonical(inter(contacts).select("chr1", "pos1", "chr2", "pos2"))
    for k in "12":
        c = met(c, near.select(F.col("contig").alias(f"name{k}"), F.col("len").alias(f"len{k}"), F.col("s").alias(f"s{k}"), F.col("e").alias(f"e{k}")), f"chr{k}", f"name{k}")
        at = F.least(f"pos{k}", f"len{k}")
        rank = lambda of, bin_: F.coalesce(F.get(of, bin_.cast("int")), F.lit(size))
        c = c.withColumns({f"s{k}": rank(f"s{k}", floor_div(at, bin_size)), f"e{k}": rank(f"e{k}", floor_div(F.col(f"len{k}") - at + 1, bin_size))}).filter(F.least(f"s{k}", f"e{k}") < size)
    counted = c.filter(F.least("s1", "e1") + F.least("s2", "e2") < size).groupBy("chr1", "chr2", "s1", "e1", "s2", "e2").agg(F.count("*").alias("n"))
    ways = F.array(*[F.struct(F.lit(ex).alias("ex"), F.col(a).alias("rx"), F.lit(ey).alias("ey"), F.col(b).alias("ry")) for ex, a in enumerate(("s1", "e1")) for ey, b in enumerate(("s2", "e2"))])
    cells = counted.select(F.col("chr1").alias("x"), F.col("chr2").alias("y"), "n", F.explode(ways).alias("w")).select("x", "y", "n", "w.*").filter(F.col("rx") + F.col("ry") < size)
    cells = cells.groupBy("x", "y", "ex", "rx", "ey", "ry").agg(F.sum("n").alias("n"))
    side = lambda s: dense.select(F.col("contig").alias(s), F.col("e").alias(f"e{s}"), F.col("w").alias(f"w{s}"), F.col("rank").alias(f"r{s}"))
    cells = cells.join(side("x"), ["x", "ex", "rx"]).join(side("y"), ["y", "ey", "ry"])
    return cells.groupBy("x", "y", (F.col("ex") + 2 * F.col("ey")).alias("code")).agg(F.bround(F.sum(F.col("n") * F.col("wx") * F.col("wy"))).cast("long").alias("score"))


def best(scores: DataFrame) -> DataFrame:
    """x, y, score, code: the best of the four codes, the lowest of equals."""
    top = scores.groupBy("x", "y").agg(F.max(F.struct("score", (-F.col("code")).alias("c"))).alias("m"))
    return top.select("x", "y", F.col("m.score").alias("score"), F.when(F.col("m.score") > 0, -F.col("m.c")).otherwise(0).alias("code"))


def both_ways(best_: DataFrame) -> DataFrame:
    back = best_.select(F.col("y").alias("x"), F.col("x").alias("y"), "score", transposed(F.col("code")).alias("code"))
    return best_.select("x", "y", "score", "code").unionByName(back)


def normalised(best_: DataFrame, least: int = 30, top: int = 5) -> DataFrame:
    """i, j, v, code: shares of a contig's scores in its largest five; contigs whose largest is not over `least` drop out."""
    w = Window.partitionBy("x")
    ranked = both_ways(best_).withColumns({"most": F.max("score").over(w), "k": F.row_number().over(w.orderBy(F.desc("score"), F.desc("y")))})
    ranked = ranked.withColumn("sum", F.sum(F.when(F.col("k") <= top, F.col("score"))).over(w)).filter(F.col("most") > least)
    return ranked.select(F.col("x").alias("i"), F.col("y").alias("j"), half(F.col("score") / F.col("sum")).alias("v"), "code")


def edges(norm: DataFrame, cutoff: float) -> DataFrame:
    """i < j, w, code: pairs that are among each other's two best, by a mean share over the cutoff."""
    w = Window.partitionBy("i").orderBy(F.desc("v"), F.desc("j"))
    two = norm.withColumn("k", F.row_number().over(w)).filter("k <= 2").drop("k")
    back = two.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("u"))
    return two.filter("i < j").join(back, ["i", "j"]).select("i", "j", ((F.col("v") + F.col("u")) / 2).alias("w"), "code").filter(F.col("w") > cutoff)
