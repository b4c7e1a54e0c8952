"""The scaffolding run: rounds of scoring and joining, with a growing triangle."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import correct, density, graph, layout, score
from ..operators.tables import known, scratch, spent
from ..sources.text import write_agp


@dataclass(frozen=True)
class Config:
    clusters: int = 5
    bin_size: int = 10_000
    cutoff: float = 0.3
    triangle: int = 3
    gap: int = 100
    error_correction: bool = False
    #: Contacts that a contig's best pair must exceed.
    least_score: int = 30
    #: Scaffolds longer than this are looked at for misjoins, and distances, in bases, between which contacts tell them.
    survey_least: int = 1_000_000
    near: int = 100_000
    far: int = 500_000
    #: Which layout is the result when a round, but the first, leaves fewer scaffolds than asked for: that of the round
    #: before, of this "last" round, or of "two_before".
    stop: str = "before"
    #: Where misjoins are cut: between the "part"s that the round has joined, whatever those hold, or between the first
    #: "contig"s, so that a misjoin seen in a later round is cut where it lies and not at the bound of an earlier block.
    breaks: str = "part"
    #: The triangle outgrows any scaffold long before.
    most_rounds: int = 60

    def __post_init__(self) -> None:
        if self.triangle < 2:
            raise ValueError("a triangle of 1 never grows")
        if self.stop not in ("before", "last", "two_before"):
            raise ValueError("stop is before, last or two_before")
        if self.breaks not in ("part", "contig"):
            raise ValueError("breaks is part or contig")


@dataclass(frozen=True)
class Rounds:
    """The rounds of a run in a folder: of round k the blocks, as a table and as {k}.agp, and, written last, {k}.done, which
    states the settings. A round without it does not count, so that a run cut off at any moment goes on from whole rounds.
    Blocks are told by those of the round before; with breaks="contig", by the first contigs.
    """

    folder: str

    def _done(self, spark, number: int) -> str | None:
        path = f"{self.folder}/{number}.done"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return spark.read.text(path).collect()[0].value if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None

    def found(self, spark, number: int, config: Config) -> DataFrame | None:
        """The blocks of a whole round, or None."""
        said = self._done(spark, number)
        if said is not None and said != str(config):
            raise ValueError(f"round {number} was made with other settings: {said}")
        return None if said is None else spark.read.parquet(f"{self.folder}/{number}.blocks")

    def commit(self, number: int, blocks: DataFrame, config: Config) -> None:
        blocks.write.mode("overwrite").parquet(f"{self.folder}/{number}.blocks")
        write_agp(layout.round_rows(layout.place(blocks, config.gap)), f"{self.folder}/{number}.agp")
        blocks.sparkSession.createDataFrame([(str(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{number}.done")

    def clear(self, spark) -> None:
        """Forgets the rounds of an earlier run."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def pair_scores(contacts: DataFrame, contigs: DataFrame, average: float, config: Config, triangle: int) -> DataFrame:
    fit = C.eligible(contigs, config.bin_size, triangle)
    dense = graph.settled(density.flagged(density.ends(contacts, fit, config.bin_size, triangle), average), "dense")
    return score.best(score.triangle(contacts, fit, dense, config.bin_size, triangle))


def average_links(contacts: DataFrame, contigs: DataFrame, config: Config) -> float:
    grid = density.diagonal(contacts, contigs, config.bin_size)
    return float(density.average_links(grid, contigs, config.bin_size).collect()[0][0] or 0.0)


def linked(contacts: DataFrame, contigs: DataFrame, average: float, config: Config, triangle: int) -> DataFrame:
    """Edges of a round. Two contigs alone are always linked."""
    best = pair_scores(contacts, contigs, average, config, triangle)
    fit = C.eligible(contigs, config.bin_size, triangle)
    two = fit.select("contig").limit(3).collect()
    if len(two) == 2:
        i, j = sorted(r.contig for r in two)
        known = best.select("code").collect()
        return contacts.sparkSession.createDataFrame([(i, j, 1.0, known[0].code if known else 0)], "i string, j string, w double, code int")
    return score.edges(score.normalised(best, config.least_score), config.cutoff)


def one_round(contacts: DataFrame, contigs: DataFrame, average: float, config: Config, triangle: int, number: int) -> DataFrame:
    """(chrom, ord, contig, len, orient): blocks that the round builds of the contigs given."""
    fit = C.eligible(contigs, config.bin_size, triangle)
    found = graph.paths(graph.settled(linked(contacts, contigs, average, config, triangle), "edges"), fit.select("contig"))
    size = found.groupBy("path").agg(F.count("*").alias("n"))
    named = found.join(size, "path").withColumn("chrom", F.when(F.col("n") == 1, F.col("contig")).otherwise(F.concat(F.lit(f"Block_{number}_"), "path")))
    return named.join(contigs, "contig").select("chrom", "ord", "contig", "len", "orient")


class Misjoins:
    """Break points of scaffolds over the first contigs. They depend on nothing but which contigs lie there, in which order
    and turn: a scaffold that was looked at before, under whatever name, is told by its parts and not looked at again."""

    def __init__(self, contacts: DataFrame, config: Config) -> None:
        self.contacts, self.config = contacts, config
        #: (parts, points) of the scaffolds that were looked at.
        self.seen: list[tuple[DataFrame, DataFrame]] = []

    def tables(self) -> list[DataFrame]:
        return [t for both in self.seen for t in both]

    def points(self, parts: DataFrame) -> DataFrame:
        """chrom, break_bin of the layout (chrom, ord, contig, len, orient) over the first contigs."""
        c, whole = self.config, Window.partitionBy("chrom")
        placed = layout.place(parts, c.gap).withColumns({"n": F.count("*").over(whole), "size": F.max("end").over(whole)})
        rest = known(placed.filter(F.col("size") > c.survey_least).select("chrom", "ord", "contig", "len", "start", "end", "orient", "n"), "long")
        out, key = [], ["contig", "start", "end", "orient", "n"]
        for there, points in self.seen:
            alike = rest.join(there.select(*key, F.col("chrom").alias("_c")), key).groupBy("chrom", "_c", "n").agg(F.count("*").alias("m"))
            same = graph.settled(alike.filter("m = n").select("chrom", "_c"), "same")
            out.append(same.join(points.withColumnRenamed("chrom", "_c"), "_c").select("chrom", "break_bin"))
            rest = graph.settled(rest.join(same, "chrom", "left_anti"), "long")
        if not self.seen or rest.limit(1).count():
            # Where both ends are on one contig, the distance is known before the contact is moved.
            apart = F.abs(F.col("pos2") - F.col("pos1"))
            some = self.contacts.filter((F.col("chr1") != F.col("chr2")) | ((apart > c.near) & (apart < c.far)))
            counts = correct.directionality(correct.surveyed(some, rest, c.survey_least), c.bin_size, c.near, c.far)
            found = graph.settled(correct.break_points(correct.signal(counts, layout.sizes(rest), c.bin_size)), "points")
            self.seen.append((rest, found))
            out.append(found)
        points = out[0]
        for more in out[1:]:
            points = points.unionByName(more)
        return points


def crossing(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """chrom: scaffolds that share contacts with another one; `pairs` are the pairs of contigs that share any."""
    at = lambda k: whole.select(F.col("contig").alias(f"chr{k}"), F.col("chrom").alias(f"_c{k}"))
    both = pairs.join(at(1), "chr1").join(at(2), "chr2").filter("_c1 <> _c2")
    return both.select(F.explode(F.array("_c1", "_c2")).alias("chrom")).distinct()


def scaffold(contacts: DataFrame, contigs: DataFrame, config: Config = Config(), rounds: Rounds | None = None, misjoins: Misjoins | None = None) -> DataFrame:
    """Final parts (chrom, ord, contig, len, orient, start, end), scaffolds numbered by falling size.

    A round lifts the first contacts by the layout so far, to a table that its readers share, of those scaffolds alone that
    share contacts with another one: nothing else can be joined. Layouts are composed, and contigs too short for a round
    come back as scaffolds of their own. With `rounds`, each round's blocks are committed, and a run goes on behind the
    last whole round that it finds there. `misjoins`, over the same contacts and settings, may know scaffolds already.
    """
    contacts = known(contacts if contacts.columns == ["chr1", "pos1", "chr2", "pos2"] else contacts.select("chr1", "pos1", "chr2", "pos2"), "contacts")
    contacts = density.profiled(contacts, contigs, config.bin_size)
    average = average_links(contacts, contigs, config)
    wholes = [contigs.select(F.col("contig").alias("chrom"), F.lit(1).alias("ord"), "contig", "len", F.lit(0).alias("orient"))]
    lengths, now, triangle, before, pairs = contigs, contacts, config.triangle, None, None
    fine, misjoins = config.breaks == "contig", misjoins or Misjoins(contacts, config)
    for number in range(config.most_rounds):
        blocks = rounds.found(contacts.sparkSession, number, config) if rounds else None
        if blocks is None:
            if C.eligible(lengths, config.bin_size, triangle).count() <= config.clusters:
                break
            if now is None:  # contacts on the scaffolds that go into this round; others went with an earlier one
                pairs = pairs or graph.settled(C.inter(contacts).select("chr1", "chr2").distinct(), "pairs")
                there = wholes[-1].join(lengths.select(F.col("contig").alias("chrom")), "chrom", "left_semi")
                there = there.join(crossing(pairs, there), "chrom", "left_semi")
                now = graph.settled(layout.lift(contacts, layout.place(there, config.gap)), "lifted")
            with scratch() as keep:
                blocks = graph.settled(one_round(now, lengths, average, config, triangle, number), "blocks")
                if config.error_correction:
                    within = graph.settled(layout.inside(wholes[-1], blocks), "within")
                    joined = blocks.filter("contig <> chrom").select("chrom").distinct()
                    points = misjoins.points(within.join(joined, "chrom", "left_semi"))
                    blocks = graph.settled(broken(points, within if fine else blocks, config), "blocks")
                keep(blocks, *misjoins.tables())
            if rounds:
                rounds.commit(number, blocks, config)
            if now is not contacts:
                spent(now)
        wholes.append(graph.settled((layout.renewed if fine and config.error_correction else layout.compose)(wholes[-1], blocks), "whole"))
        sizes = layout.sizes(layout.place(blocks, config.gap))
        last, lengths = lengths, graph.settled(sizes.select(F.col("chrom").alias("contig"), F.col("size").alias("len")), "lengths")
        if last is not contigs:
            spent(last)
        now, count = None, lengths.count()
        if before is not None and count < config.clusters <= before:
            wholes = wholes[: len(wholes) - {"last": 0, "before": 1, "two_before": 2}[config.stop]]
            break
        before, triangle = count, round(triangle * 1.4)
    else:
        raise RuntimeError(f"not settled after {config.most_rounds} rounds")
    return layout.renumbered(layout.place(wholes[-1], config.gap))


def corrected(contacts: DataFrame, blocks: DataFrame, config: Config, within: DataFrame | None = None) -> DataFrame:
    """Blocks broken where the contacts of long ones show a misjoin, between their parts or, if given, between those of
    `within`: the same scaffolds by finer parts, the first contigs. One of these that is cut off by itself lies forward."""
    placed = layout.place(blocks, config.gap)
    counts = correct.directionality(correct.surveyed(contacts, placed, config.survey_least), config.bin_size, config.near, config.far)
    points = correct.break_points(correct.signal(counts, layout.sizes(placed), config.bin_size))
    return broken(points, blocks if within is None else within, replace(config, breaks="part" if within is None else "contig"))


def broken(points: DataFrame, parts: DataFrame, config: Config) -> DataFrame:
    """The layout cut at its parts nearest to the points. With breaks="contig", a part that is cut off by itself lies forward."""
    placed = layout.place(parts, config.gap)
    return correct.pieces(placed, correct.snapped(points, placed, config.bin_size), forward=config.breaks == "contig")
