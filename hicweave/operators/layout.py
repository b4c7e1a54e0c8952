"""Layouts: where contigs lie on scaffolds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import known, met, numbered, running


def place(parts: DataFrame, gap: int = 100) -> DataFrame:
    """Adds start and end to (chrom, ord, contig, len, orient): parts in order with a gap between."""
    before = Window.partitionBy("chrom").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("len") + gap).over(before), F.lit(0)) + 1
    out = parts.withColumn("start", start)
    return out.withColumn("end", F.col("start") + F.col("len") - 1)


def place_joined(parts: DataFrame) -> DataFrame:
    """Adds start and end by the review tool's rule: a part begins where the last one ends, without a step between."""
    before = Window.partitionBy("chrom").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    done = F.sum("len").over(before)
    return parts.withColumns({"start": F.coalesce(done, F.lit(1)).cast("long"), "end": (F.coalesce(done, F.lit(0)) + F.col("len")).cast("long")})


def place_chained(parts: DataFrame, gap: int = 100) -> DataFrame:
    """Nine-column rows by the rule of the review tool's chains: parts and the gaps between them each begin where the
    row before ends, without a step; places count on over both."""
    w = Window.partitionBy("chrom").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = parts.withColumns({"k": F.row_number().over(w) - 1, "done": F.coalesce(F.sum(F.col("len") + gap).over(before), F.lit(0)), "last": F.lead("contig").over(w).isNull()})
    part = p.select("chrom", F.greatest("done", F.lit(1)).cast("long").alias("start"), (F.col("done") + F.col("len")).cast("long").alias("end"), (2 * F.col("k") + 1).alias("ord"), F.lit("W").alias("tag"), "contig", F.lit("1").alias("contig_start"), F.col("len").cast("string").alias("contig_end"), F.when(F.col("orient") == 1, "-").otherwise("+").alias("orient"))
    stop = F.col("done") + F.col("len")
    gaps = p.filter("not last").select("chrom", stop.cast("long").alias("start"), (stop + gap).cast("long").alias("end"), (2 * F.col("k") + 2).alias("ord"), F.lit("U").alias("tag"), F.lit(str(gap)).alias("contig"), F.lit("scaffold").alias("contig_start"), F.lit("yes").alias("contig_end"), F.lit("proximity_ligation").alias("orient"))
    return part.unionByName(gaps)


def place_super(parts: DataFrame, name: str = "assembly") -> DataFrame:
    """All parts of a layout on one scaffold, in the order of their scaffolds, as the review tool draws them: a part begins
    where the last one ends. No task sees all parts."""
    at = running(parts.select("chrom", "ord", "contig", "len", "orient"), ["chrom", "ord"], {"done": F.col("len"), "k": F.lit(1).cast("long")})
    return at.select(F.lit(name).alias("chrom"), (F.col("k") + 1).alias("ord"), "contig", "len", "orient", F.greatest("done", F.lit(1)).cast("long").alias("start"), (F.col("done") + F.col("len")).cast("long").alias("end"))


def initial(contigs: DataFrame) -> DataFrame:
    """Each contig a scaffold of its own, in nine columns."""
    return contigs.select(F.col("contig").alias("chrom"), F.lit(1).cast("long").alias("start"), F.col("len").alias("end"), F.lit(1).alias("ord"), F.lit("W").alias("tag"), "contig", F.lit(1).cast("long").alias("contig_start"), F.col("len").alias("contig_end"), F.lit(0).alias("orient"))


def round_rows(placed: DataFrame) -> DataFrame:
    """Nine-column rows of a round's layout: parts alone, orientation as 0 or 1."""
    return placed.select("chrom", "start", "end", F.lit(1).alias("ord"), F.lit("W").alias("tag"), "contig", F.lit(1).cast("long").alias("contig_start"), F.col("len").alias("contig_end"), "orient")


def renumbered(placed: DataFrame) -> DataFrame:
    """Scaffolds named scaffold_1, scaffold_2 ... by falling size; the smaller first contig comes first of equals. The
    ranking is over scaffolds, not parts, by ranges of their sizes."""
    sizes = placed.groupBy("chrom").agg(F.max("end").alias("size"), F.min("contig").alias("first"))
    names = numbered(sizes, [F.desc("size"), F.asc("first")]).select("chrom", F.concat(F.lit("scaffold_"), F.col("number").cast("string")).alias("name"))
    return placed.join(names, "chrom").drop("chrom").withColumnRenamed("name", "chrom")


def with_gaps(placed: DataFrame, gap: int = 100) -> DataFrame:
    """Nine-column rows: parts at odd places, gaps between them at even ones."""
    w = Window.partitionBy("chrom").orderBy("ord")
    p = placed.withColumns({"k": F.row_number().over(w) - 1, "next": F.lead("start").over(w)})
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    part = p.select("chrom", "start", "end", (2 * F.col("k") + 1).alias("ord"), F.lit("W").alias("tag"), "contig", F.lit("1").alias("contig_start"), s("len").alias("contig_end"), F.when(F.col("orient") == 1, "-").otherwise("+").alias("orient"))
    gaps = p.filter("next is not null").select("chrom", (F.col("end") + 1).alias("start"), (F.col("next") - 1).alias("end"), (2 * F.col("k") + 2).alias("ord"), F.lit("U").alias("tag"), F.lit(str(gap)).alias("contig"), F.lit("scaffold").alias("contig_start"), F.lit("yes").alias("contig_end"), F.lit("proximity_ligation").alias("orient"))
    return part.unionByName(gaps)


def sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("chrom").agg(F.max("end").alias("size"))


def inside(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Parts of parent's scaffolds in terms of child's contigs: child (chrom, ord, contig, len, orient), parent the same
    over child's chroms. A reversed scaffold turns the order and the orientation of its parts."""
    p = parent.select(F.col("chrom").alias("_c"), F.col("ord").alias("_o"), F.col("contig").alias("_s"), F.col("orient").alias("_r"))
    j = child.join(p, child["chrom"] == p["_s"])
    within = F.when(F.col("_r") == 1, -F.col("ord")).otherwise(F.col("ord"))
    order = F.row_number().over(Window.partitionBy("_c").orderBy("_o", within))
    return j.select(F.col("_c").alias("chrom"), order.alias("ord"), "contig", "len", F.col("orient").bitwiseXOR(F.col("_r")).alias("orient"))


def compose(child: DataFrame, parent: DataFrame) -> DataFrame:
    """As `inside`, and the scaffolds that parent does not use as they are."""
    rest = child.join(parent.select(F.col("contig").alias("chrom")), "chrom", "left_anti").select("chrom", "ord", "contig", "len", "orient")
    return inside(child, parent).unionByName(rest)


def renewed(child: DataFrame, parts: DataFrame) -> DataFrame:
    """parts, a layout of some of child's contigs, and the scaffolds of the others as they are."""
    rest = child.join(parts.select("contig"), "contig", "left_anti").select("chrom", "ord", "contig", "len", "orient")
    return parts.select("chrom", "ord", "contig", "len", "orient").unionByName(rest)


def lift(contacts: DataFrame, placed: DataFrame) -> DataFrame:
    """Contacts in scaffold coordinates; those with an unplaced end go.

    The layout is a table by then, whose size is known before the joins are planned: as long as it is small, contacts meet
    it where they lie and are not shuffled.
    """
    out, placed = contacts, known(placed.select("contig", "chrom", "start", "end", "orient"), "layout")
    for c, p in (("chr1", "pos1"), ("chr2", "pos2")):
        at = placed.select(F.col("contig").alias("_n"), F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("orient").alias("_r"))
        moved = F.when(F.col("_r") == 1, F.col("_e") - F.col(p) + 1).otherwise(F.col("_s") + F.col(p) - 1)
        out = met(out, at, c, "_n").withColumns({c: F.col("_c"), p: moved}).drop("_n", "_c", "_s", "_e", "_r")
    return out


def adjacent(placed: DataFrame) -> DataFrame:
    """Neighbours on scaffolds and which of their ends meet: s for start, e for end."""
    w = Window.partitionBy("chrom").orderBy("ord")
    n = placed.select("chrom", "contig", "orient", F.lead("contig").over(w).alias("next"), F.lead("orient").over(w).alias("next_orient")).filter("next is not null")
    return n.select("chrom", "contig", "next", F.concat(F.when(F.col("orient") == 1, "s").otherwise("e"), F.when(F.col("next_orient") == 1, "e").otherwise("s")).alias("tag"))


def connections(initial_parts: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """round, chrom, contig, next, tag: neighbours after each round, in terms of the first contigs. Each round's layout
    (chrom, ord, contig, len, orient) is over the scaffolds of the one before."""
    whole, out = initial_parts, None
    for k, blocks in enumerate(rounds):
        whole = compose(whole, blocks)
        found = adjacent(whole).select(F.lit(k).alias("round"), "chrom", "contig", "next", "tag")
        out = found if out is None else out.unionByName(found)
    return out
