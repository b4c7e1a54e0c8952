"""Misjoins: where contacts stop crossing a scaffold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_div
from .layout import lift, sizes
from .tables import known, settled


def surveyed(contacts: DataFrame, placed: DataFrame, least: int = 1_000_000) -> DataFrame:
    """Lifted contacts within one scaffold that is longer than `least` and is not just its first contact's contig: a
    contig that was joined to nothing keeps its name as a scaffold. Only the layout of such scaffolds meets the contacts."""
    long = sizes(placed).filter(F.col("size") > least).select("chrom")
    on = known(placed.join(long, "chrom", "left_semi").select("contig", "chrom", "start", "end", "orient"), "surveyed")
    return lift(contacts.withColumn("_first", F.col("chr1")), on).filter("chr1 = chr2 and _first <> chr1").drop("_first")


def directionality(inside: DataFrame, bin_size: int, near: int = 100_000, far: int = 500_000) -> DataFrame:
    """chrom, bin, down, up: surveyed contacts over middling distances, at the bin of their larger (down) and of their
    smaller position (up)."""
    inside = inside.withColumn("d", F.abs(F.col("pos2") - F.col("pos1"))).filter((F.col("d") > near) & (F.col("d") < far))
    at = inside.select(F.col("chr1").alias("chrom"), F.explode(F.array(F.struct(floor_div(F.greatest("pos1", "pos2"), bin_size).alias("bin"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(floor_div(F.least("pos1", "pos2"), bin_size).alias("bin"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("x"))
    return at.groupBy("chrom", F.col("x.bin").alias("bin")).agg(F.sum("x.down").alias("down"), F.sum("x.up").alias("up"))


def signal(counts: DataFrame, sizes_: DataFrame, bin_size: int) -> DataFrame:
    """chrom, bin, s: log ratio for every bin of every scaffold that has counts. Counts are written down, as they are read
    twice here, and so are the ratios, which are read many times: contacts are met once."""
    counts = known(counts, "counts")
    some = sizes_.join(counts.select("chrom").distinct(), "chrom", "left_semi")
    grid = some.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), floor_div(F.col("size"), bin_size))).alias("bin"))
    full = grid.join(counts, ["chrom", "bin"], "left").fillna(0, ["down", "up"])
    return settled(full.select("chrom", "bin", F.log10((F.col("down") + 1) / (F.col("up") + 1)).alias("s")), "signal")


#: Bins cut at either end, quantiles kept, width of means, share of the highest peak, bins searched for a
#: minimum before a peak, least drop.
EDGE, LOW, HIGH, WIDTH, SHARE, BACK, DROP = 50, 0.005, 0.995, 10, 0.7, 40, 0.60
#: Bins of a range. Windows over bins run within ranges, to which the bins that their neighbours need are added.
SPAN = 4096


def _range(at: str, span: int, off: int = 0) -> Column:
    return F.floor((F.col(at) + off) / span)


def _haloed(df: DataFrame, at: str, before: int, after: int, span: int) -> DataFrame:
    """Rows in every range `_r` whose windows, from `before` rows back to `after` ahead, reach them."""
    return df.withColumn("_r", F.explode(F.sequence(_range(at, span, -after), _range(at, span, before))))


def mirrored_mean(signals: DataFrame, size: int = WIDTH, span: int = SPAN) -> DataFrame:
    """chrom, bin, mean: means over size neighbours, one more before than after where size is even, with the signal
    mirrored at both edges; bins count from 0 without a hole. The mirror images are rows of their own."""
    before, after = size // 2, size - 1 - size // 2
    n = signals.groupBy("chrom").agg((F.max("bin") + 1).alias("n"))
    image = lambda at, use: F.when(use, at)
    places = F.array(F.col("bin"), image(-1 - F.col("bin"), F.col("bin") < before), image(2 * F.col("n") - 1 - F.col("bin"), F.col("bin") >= F.col("n") - after))
    full = signals.join(n, "chrom").select("chrom", "n", "s", F.explode(F.array_compact(places)).alias("bin"))
    mean = F.avg("s").over(Window.partitionBy("chrom", "_r").orderBy("bin").rowsBetween(-before, after))
    own = _haloed(full, "bin", before, after, span).withColumn("mean", mean).filter((F.col("_r") == _range("bin", span)) & (F.col("bin") >= 0) & (F.col("bin") < F.col("n")))
    return own.select("chrom", "bin", "mean")


def tops(means: DataFrame, span: int = SPAN) -> DataFrame:
    """chrom, p, mean: places higher than both sides; of a flat top its middle, rounded down; never an edge.

    A flat stretch is told by where it starts: the next start is sought in its range of bins and, where that has no more,
    among the first starts of the ranges behind it, so that stretches may cross any number of ranges.
    """
    inside = Window.partitionBy("chrom", "_r").orderBy("bin")
    at = _haloed(means, "bin", 1, 0, span).withColumn("prior", F.lag("mean").over(inside)).filter(F.col("_r") == _range("bin", span))
    starts = settled(at.filter(F.col("prior").isNull() | (F.col("prior") != F.col("mean"))), "starts")
    first = starts.groupBy("chrom", "_r").agg(F.min(F.struct("bin", "mean")).alias("first"))
    behind = F.min("first").over(Window.partitionBy("chrom").orderBy("_r").rowsBetween(1, Window.unboundedFollowing))
    later = first.select("chrom", "_r", behind.alias("later"))  # one row for each range
    follow = F.lead(F.struct("bin", "mean")).over(inside)
    ends = starts.withColumn("follow", follow).join(later, ["chrom", "_r"]).withColumn("next", F.coalesce("follow", "later"))
    high = ends.filter(F.col("prior").isNotNull() & F.col("next").isNotNull() & (F.col("mean") > F.col("prior")) & (F.col("mean") > F.col("next.mean")))
    return high.select("chrom", F.floor((F.col("bin") + F.col("next.bin") - 1) / 2).alias("p"), "mean")


def break_points(signals: DataFrame, span: int = SPAN) -> DataFrame:
    """chrom, break_bin: midway between a peak and the lowest point before it, once for each low point. Clipping also holds
    for the values in which the low point is sought; its value is cut to a whole number. Means are rounded to nine places,
    so that a flat top is flat whatever the order of additions. Scaffolds of few bins have none.

    Windows run over ranges of bins, peaks meet the bins before them by a join: no task holds a scaffold's signal.
    """
    size = signals.groupBy("chrom").agg((F.max("bin") + 1).alias("n")).filter(F.col("n") > 2 * EDGE)
    whole = signals.join(size, "chrom").withColumn("inner", (F.col("bin") >= EDGE) & (F.col("bin") < F.col("n") - EDGE))
    limits = whole.filter("inner").groupBy("chrom").agg(F.percentile("s", F.lit(LOW)).alias("low"), F.percentile("s", F.lit(HIGH)).alias("high"))
    kept = F.when(F.col("inner"), F.greatest(F.least("s", "high"), "low")).otherwise(F.col("s"))
    whole = settled(whole.join(limits, "chrom").select("chrom", "bin", "inner", kept.alias("v")), "clipped")
    means = mirrored_mean(whole.filter("inner").select("chrom", (F.col("bin") - EDGE).alias("bin"), F.col("v").alias("s")), WIDTH, span)
    means = settled(means.withColumn("mean", F.round("mean", 9)), "means")
    highest = means.groupBy("chrom").agg(F.max("mean").alias("highest"))
    peaks = tops(means, span).join(highest, "chrom").filter(F.col("mean") >= F.col("highest") * SHARE).select("chrom", "p")
    at = peaks.select("chrom", "p", F.explode(F.sequence(F.col("p") + EDGE - BACK, F.col("p") + EDGE)).alias("bin")).join(whole, ["chrom", "bin"])
    low = at.groupBy("chrom", "p").agg(F.min(F.struct("v", "bin")).alias("low"), F.max(F.when(F.col("bin") == F.col("p") + EDGE, F.col("v"))).alias("v"))
    deep = low.filter(F.col("v") - F.col("low.v").cast("long") > DROP)
    # Low points never move back from one peak to the next, so that equal ones follow each other: the first peak stays.
    return deep.groupBy("chrom", F.col("low.bin").alias("spot")).agg(F.min("p").alias("p")).select("chrom", ((F.col("spot") + F.col("p") + EDGE) / 2).alias("break_bin"))


def snapped(points: DataFrame, placed: DataFrame, bin_size: int) -> DataFrame:
    """chrom, cut: number of the part whose start is nearest to each break, the first of equals; parts count from 0.

    Parts and breaks of a scaffold are laid in one order of position, and a break looks back to the last part and ahead to
    the next one: each row is met once, whatever their numbers.
    """
    part = placed.select("chrom", F.col("start").cast("double").alias("at"), (F.col("ord") - 1).alias("k"), "start")
    both = part.unionByName(points.select("chrom", (F.col("break_bin") * bin_size).cast("double").alias("at")).distinct(), allowMissingColumns=True)
    # Of a part and a break at one place, the part comes first; parts with one start count as the first of them.
    first = both.withColumn("k", F.when(F.col("k").isNotNull(), F.min("k").over(Window.partitionBy("chrom", "start"))))
    w = Window.partitionBy("chrom").orderBy("at", F.col("k").isNull(), "k")
    seen = F.struct("start", "k")
    back = F.last(F.when(F.col("k").isNotNull(), seen), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(F.col("k").isNotNull(), seen), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = first.withColumns({"b": back, "a": ahead}).filter("k is null")
    away = lambda c: F.abs(F.col(f"{c}.start") - F.col("at"))
    cut = F.when(F.col("a").isNull() | (away("b") < away("a")), F.col("b.k")).when(F.col("b").isNull() | (away("a") < away("b")), F.col("a.k")).otherwise(F.least("a.k", "b.k"))
    return near.select("chrom", cut.alias("cut")).filter("cut is not null").distinct()


def pieces(placed: DataFrame, cuts: DataFrame, forward: bool = False) -> DataFrame:
    """(chrom, ord, contig, len, orient) with scaffolds cut before the given parts into {chrom}_break_1, _2 ...; scaffolds
    without a cut keep their names, those with a cut before their first part alone become {chrom}_break_1. A part that is
    cut off by itself keeps its turn, as in the reference; with `forward` it lies forward, as one that was never joined."""
    at = cuts.select("chrom", (F.col("cut") + 1).alias("ord"), F.lit(1).alias("c")).distinct()
    marked = placed.join(at, ["chrom", "ord"], "left")
    whole = Window.partitionBy("chrom")
    before = F.sum(F.when(F.col("ord") > 1, F.col("c"))).over(whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumns({"piece": F.coalesce(before, F.lit(0)) + 1, "any": F.max("c").over(whole)})
    name = F.when(F.col("any") == 1, F.concat("chrom", F.lit("_break_"), F.col("piece").cast("string"))).otherwise(F.col("chrom"))
    piece = Window.partitionBy("chrom", "piece")
    marked = marked.withColumn("o", F.row_number().over(piece.orderBy("ord")))
    if forward:
        marked = marked.withColumn("orient", F.when(F.count("*").over(piece) > 1, F.col("orient")).otherwise(0))
    return marked.select(name.alias("chrom"), F.col("o").alias("ord"), "contig", "len", "orient")


def same_bin(inside: DataFrame, bin_size: int, near: int = 100_000) -> DataFrame:
    """chrom, bin, n: surveyed contacts with both ends in one bin and no further apart than `near`."""
    a, b = floor_div(F.col("pos1"), bin_size), floor_div(F.col("pos2"), bin_size)
    inside = inside.filter(F.abs(F.col("pos2") - F.col("pos1")) <= near)
    return inside.filter(a == b).groupBy(F.col("chr1").alias("chrom"), a.alias("bin")).agg(F.count("*").alias("n"))


def windows(signals: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds mean over WIDTH neighbours (fewer at the edges) and low, the least of the BACK bins before and the bin."""
    w = Window.partitionBy("chrom", "_r").orderBy("bin")
    after = WIDTH - WIDTH // 2 - 1
    out = _haloed(signals, "bin", BACK, after, span).withColumns({"mean": F.avg("s").over(w.rowsBetween(-(WIDTH // 2), after)), "low": F.min("s").over(w.rowsBetween(-BACK, 0))})
    return out.filter(F.col("_r") == _range("bin", span)).drop("_r")
