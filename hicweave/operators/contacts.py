"""Filters and projections of contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_div


def eligible(contigs: DataFrame, bin_size: int, triangle: int) -> DataFrame:
    """Contigs long enough for the triangle."""
    return contigs.filter(F.col("len") >= bin_size * triangle)


def known(contacts: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contacts whose both ends are on contigs of the table. The table's size decides how the joins run."""
    names = contigs.select("contig")
    return contacts.join(names.withColumnRenamed("contig", "chr1"), "chr1", "left_semi").join(names.withColumnRenamed("contig", "chr2"), "chr2", "left_semi")


def canonical(contacts: DataFrame) -> DataFrame:
    """Ends swapped, with all their columns, where the first name is the larger one; names compare by bytes."""
    swap = F.col("chr1") > F.col("chr2")
    other = {f"{c[:-1]}1": f"{c[:-1]}2" for c in contacts.columns if c.endswith("1") and f"{c[:-1]}2" in contacts.columns}
    other |= {b: a for a, b in other.items()}
    return contacts.select(*[F.when(swap, F.col(other[c])).otherwise(F.col(c)).alias(c) if c in other else F.col(c) for c in contacts.columns])


def with_lengths(contacts: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds len1 and len2, and clamps positions to them."""
    out = contacts.join(contigs.select(F.col("contig").alias("chr1"), F.col("len").alias("len1")), "chr1")
    out = out.join(contigs.select(F.col("contig").alias("chr2"), F.col("len").alias("len2")), "chr2")
    return out.select("chr1", F.least("pos1", "len1").alias("pos1"), "len1", "chr2", F.least("pos2", "len2").alias("pos2"), "len2")


def end_bins(pos: Column, length: Column, bin_size: int) -> Column:
    """Bins of a position, counted from the start (e = 0) and from the end (e = 1) of its contig."""
    return F.array(F.struct(F.lit(0).alias("e"), floor_div(pos, bin_size).alias("bin")), F.struct(F.lit(1).alias("e"), floor_div(length - pos + 1, bin_size).alias("bin")))


def intra(contacts: DataFrame) -> DataFrame:
    return contacts.filter("chr1 = chr2")


def inter(contacts: DataFrame) -> DataFrame:
    return contacts.filter("chr1 <> chr2")


def split_by_segments(contacts: DataFrame, segments: DataFrame) -> DataFrame:
    """Contacts moved onto segments (contig, seg, start, end) of their contigs: the first segment that holds a position
    wins, positions count from 1. Where segments overlap, the part that an earlier one holds is taken off the later one
    before any contact is met.

    A segment lies in one or two cells of the least power of two that is no shorter than it, whatever its length; a
    position looks into its cell of each width that occurs, 63 at most. So the join is on equality, by contig, width and
    cell, and segments of a kilobase and of a gigabase may stand side by side.
    """
    before = Window.partitionBy("contig").orderBy("start", "end", "seg").rowsBetween(Window.unboundedPreceding, -1)
    own = segments.withColumn("own", F.greatest("start", F.coalesce(F.max("end").over(before) + 1, F.col("start")))).filter("own <= end")
    length = F.col("end") - F.col("own") + 1
    own = own.withColumn("width", F.when(length > 1, F.length(F.bin(length - 1))).otherwise(0))
    widths = [r.width for r in own.select("width").distinct().collect()]
    cells = own.withColumn("cell", F.explode(F.expr("sequence(shiftright(own, width), shiftright(end, width))"))).select(*[F.col(c).alias(f"_{c}") for c in ("contig", "seg", "start", "end", "own", "width", "cell")])

    def moved(df: DataFrame, c: str, p: str) -> DataFrame:
        at = df.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>"))).withColumn("_c", F.expr(f"shiftright({p}, _w)"))
        near = at.join(cells, (F.col(c) == F.col("_contig")) & (F.col("_w") == F.col("_width")) & (F.col("_c") == F.col("_cell")) & (F.col(p) >= F.col("_own")) & (F.col(p) <= F.col("_end")))
        return near.withColumns({c: F.col("_seg"), p: F.col(p) - F.col("_start") + 1}).select(*df.columns)

    return moved(moved(contacts, "chr1", "pos1"), "chr2", "pos2")
