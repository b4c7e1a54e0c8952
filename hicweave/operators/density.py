"""Contact densities along contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_div
from .contacts import intra
from .tables import met, quantiles, settled


def profile(contacts: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """contig, s, e, same, n: contacts within a contig by the bins of their first position, counted from the contig's start
    and from its end, and by whether their second one is in the same bin. Both densities come from it by few rows."""
    pos = F.least("pos1", "len")
    s, e = floor_div(pos, bin_size), floor_div(F.col("len") - pos + 1, bin_size)
    same = (floor_div(F.col("pos1"), bin_size) == s) & (floor_div(F.col("pos2"), bin_size) == s)
    at = met(intra(contacts), contigs.select("contig", "len"), "chr1", "contig").select("contig", s.alias("s"), e.alias("e"), same.alias("same"))
    return at.groupBy("contig", "s", "e", "same").agg(F.count("*").alias("n"))


def profiled(contacts: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """The same contacts, which bring their profile along as a table: densities of these contigs, or of some of them, are
    read off it."""
    out = contacts.select("*")
    out._profile = bin_size, settled(profile(contacts, contigs, bin_size), "profile")
    return out


def _counts(contacts: DataFrame, bin_size: int) -> DataFrame | None:
    size, counts = getattr(contacts, "_profile", (None, None))
    return counts if size == bin_size else None


def diagonal(contacts: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """contig, bin, n: contacts with both ends in a bin, for every bin of every contig."""
    counts = _counts(contacts, bin_size)
    b1, b2 = floor_div(F.col("pos1"), bin_size), floor_div(F.col("pos2"), bin_size)
    if counts is None:
        counted = intra(contacts).filter(b1 == b2).groupBy(F.col("chr1").alias("contig"), b1.alias("bin")).agg(F.count("*").alias("n"))
    else:
        counted = counts.filter("same").groupBy("contig", F.col("s").alias("bin")).agg(F.sum("n").alias("n"))
    grid = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), floor_div(F.col("len"), bin_size))).alias("bin"))
    return grid.join(counted, ["contig", "bin"], "left").select("contig", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def average_links(density: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """The exact median over all bins but each contig's last."""
    inner = density.join(contigs, "contig").filter(F.col("bin") < floor_div(F.col("len"), bin_size))
    return quantiles(inner, "n", [0.5]).agg(F.max("value").alias("average_links"))


def ends(contacts: DataFrame, contigs: DataFrame, bin_size: int, triangle: int) -> DataFrame:
    """contig, e, bin, n: contacts within a contig, by the bin of their first position from either end."""
    counts, limit = _counts(contacts, bin_size), 10 * triangle
    both = profile(contacts, contigs, bin_size) if counts is None else counts.join(contigs.select("contig"), "contig", "left_semi")
    each = both.select("contig", "n", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("s").alias("bin")), F.struct(F.lit(1).alias("e"), F.col("e").alias("bin")))).alias("b"))
    return each.filter(F.col("b.bin") < limit).groupBy("contig", F.col("b.e").alias("e"), F.col("b.bin").alias("bin")).agg(F.sum("n").alias("n"))


def flagged(end_density: DataFrame, average: float, least: float = 30, share: float = 0.3) -> DataFrame:
    """Dense bins with their weight w and rank from the contig's end."""
    dense = end_density.filter(F.col("n") >= max(share * average, least)).withColumn("w", F.lit(float(average)) / (F.col("n") + 1))
    return dense.withColumn("rank", F.row_number().over(Window.partitionBy("contig", "e").orderBy("bin")) - 1)


def contact_map(contacts: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """x, y, code, bx, by, n: binned contacts of pairs of contigs for the four ways to turn them. Positions count from 0 and
    are clamped to the length; a turned axis counts from the length on. A contact within one contig also counts with its
    two bins exchanged, where they differ."""
    from .contacts import canonical

    lengths = lambda c, n: contigs.select(F.col("contig").alias(c), F.col("len").alias(n))
    c = canonical(contacts.select("chr1", "pos1", "chr2", "pos2")).join(lengths("chr1", "len1"), "chr1").join(lengths("chr2", "len2"), "chr2")
    place = lambda p, n: F.least(F.col(p) - 1, F.col(n))
    bins = lambda p, n: F.array(F.struct(F.lit(0).alias("e"), floor_div(place(p, n), bin_size).alias("bin")), F.struct(F.lit(1).alias("e"), floor_div(F.col(n) - place(p, n), bin_size).alias("bin")))
    c = c.select("chr1", "chr2", F.explode(bins("pos1", "len1")).alias("p"), bins("pos2", "len2").alias("q")).select("chr1", "chr2", "p", F.explode("q").alias("q"))
    cells = c.groupBy(F.col("chr1").alias("x"), F.col("chr2").alias("y"), (F.col("p.e") + 2 * F.col("q.e")).alias("code"), F.col("p.bin").alias("bx"), F.col("q.bin").alias("by")).agg(F.count("*").alias("n"))
    mirror = cells.filter("x = y and bx <> by").select("x", "y", "code", F.col("by").alias("bx"), F.col("bx").alias("by"), "n")
    return cells.unionByName(mirror).groupBy("x", "y", "code", "bx", "by").agg(F.sum("n").alias("n"))
