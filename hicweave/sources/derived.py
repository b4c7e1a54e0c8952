"""Contigs, contacts and layouts derived from the given tables, with a planted order.

Each supplier is a contig of 100,000 bases; they lie five to a chromosome in the order of their names, and those with
number % 3 = 1 are reversed. Each line item stands for COPIES contacts of its supplier's contig.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import floor_div
from ..operators.tables import settled

CONTIG_LENGTH = 100_000
PER_CHROMOSOME = 5
COPIES = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(k: Column) -> Column:
    return F.concat(F.lit("ctg"), F.lpad(k.cast("string"), 6, "0"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(_name(F.col("s_suppkey")).alias("contig"), F.lit(CONTIG_LENGTH).cast("long").alias("len"))


def known_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of the suppliers that are not in debt."""
    return read(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(_name(F.col("s_suppkey")).alias("contig"))


#: Stored tables of a session: by the application, the name and the folder that they were derived from.
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(make):
    """A derived table that a session works out once for each folder. Its expressions would otherwise be written into each
    condition on it; read back, it is four columns."""

    @functools.wraps(make)
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, make.__name__, sf_dir)
        if key not in _STORED:
            _STORED[key] = settled(make(spark, sf_dir), make.__name__)
        return _STORED[key]

    return found


def _line_items(spark: SparkSession, sf_dir: str, copies: int, **more: Column) -> DataFrame:
    """k1, q (1 to 50), number and x, which tell items apart, and `more`, columns of k1: `copies` rows for each line item.

    Line items are dealt and sorted by their contig while they are narrow and few, so that the contacts of a contig lie side
    by side and later counts by contig shrink before they are shuffled. What depends on the contig alone is worked out before the
    copies are made: a condition on the copies is pushed down with all expressions it uses, and must find these as columns.
    """
    number = F.col("l_partkey").cast("long") * 7919 + F.col("l_orderkey").cast("long") * 104729 + F.col("l_linenumber").cast("long") * 15485863
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("k1"), F.col("l_quantity").cast("long").alias("q"), number.alias("number"), F.col("l_orderkey").cast("long").alias("x"))
    line = line.repartition("k1").sortWithinPartitions("k1").withColumns({"name1": _name(F.col("k1")), **more})
    line = line.withColumn("c", F.explode(F.array(*[F.lit(c) for c in range(copies)])))
    return line.withColumns({"q": (F.col("q") + 7 * F.col("c") - 1) % 50 + 1, "number": F.col("number") + F.col("c") * 611953}).drop("c")


def _turned(k: str, o: str, length: Column | int = CONTIG_LENGTH) -> Column:
    return F.when(F.col(k) % 3 == 1, length - F.col(o)).otherwise(F.col(o) + 1)


def _ends() -> list[Column]:
    """Both ends of contacts from k1, o1, k2 and o2."""
    name2 = F.when(F.col("k2") == F.col("k1"), F.col("name1")).otherwise(_name(F.col("k2")))
    return [F.col("name1").alias("chr1"), _turned("k1", "o1").alias("pos1"), name2.alias("chr2"), _turned("k2", "o2").alias("pos2")]


@stored
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line_items(spark, sf_dir, COPIES)
    far = F.col("q") - 35
    line = line.withColumns({"o1": F.col("number") % CONTIG_LENGTH, "d": F.when(F.col("q") <= 35, F.col("q") * 200 + F.col("x") % 200).otherwise(far * far * 300 + F.col("x") % 300)})
    line = line.withColumn("a", F.col("o1") + F.col("d"))
    line = line.filter(F.col("k1") % PER_CHROMOSOME * CONTIG_LENGTH + F.col("a") < PER_CHROMOSOME * CONTIG_LENGTH)  # contacts beyond a chromosome go
    return line.withColumns({"k2": F.col("k1") + floor_div(F.col("a"), CONTIG_LENGTH), "o2": F.col("a") % CONTIG_LENGTH}).select(*_ends())


#: Of each LONG_GROUP suppliers, the first 15 are a chromosome, the next 12, the next 5, and the last one is a contig of
#: LONE_LENGTH bases by itself.
LONG_GROUP, LONE_LENGTH, LONG_COPIES = 33, 1_500_000, 8


def _long_place(k: Column) -> tuple[Column, Column, Column]:
    """Chromosome (A, B, C or D, with the number of the group), place in it, from 0, and its number of contigs."""
    g, r = floor_div(k, LONG_GROUP), k % LONG_GROUP
    by = lambda a, b, c, d: F.when(r < 15, a).when(r < 27, b).when(r < 32, c).otherwise(d)
    return F.concat(F.lit("lng"), g.cast("string"), by("A", "B", "C", "D")), by(r, r - 15, r - 27, 0), by(15, 12, 5, 1)


def long_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planted layout with scaffolds of more and of less than a megabase: chrom, ord, contig, len, orient. A lone contig
    is a scaffold of its own name."""
    k = F.col("s_suppkey").cast("long")
    chrom, place, _ = _long_place(k)
    alone = k % LONG_GROUP == LONG_GROUP - 1
    return read(spark, sf_dir, "supplier").select(
        F.when(alone, _name(k)).otherwise(chrom).alias("chrom"), (place + 1).cast("int").alias("ord"), _name(k).alias("contig"),
        F.when(alone, LONE_LENGTH).otherwise(CONTIG_LENGTH).cast("long").alias("len"), F.when((k % 3 == 1) & ~alone, 1).otherwise(0).alias("orient"),
    )


@stored
def long_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of up to 600 kb on the long layout. In the first chromosome of every other group nothing over 50 kb crosses
    the bound between the seventh and the eighth contig: a misjoin."""
    k = F.col("k1")
    alone = k % LONG_GROUP == LONG_GROUP - 1
    _, place, many = _long_place(k)
    span = F.when(alone, LONE_LENGTH).otherwise(CONTIG_LENGTH)
    # Where contacts of a contig end: with its chromosome, or with itself. The bound that far ones do not cross, if any.
    bound = F.when((many == 15) & (floor_div(k, LONG_GROUP) % 2 == 0), 7 * CONTIG_LENGTH).otherwise(-1)
    line = _line_items(spark, sf_dir, LONG_COPIES, alone=alone, begin=place * CONTIG_LENGTH, span=span, stop=span * many, bound=bound)
    far = F.col("q") - 25
    line = line.withColumns({"o1": F.col("number") % F.col("span"), "d": F.when(F.col("q") <= 25, F.col("q") * 200 + F.col("x") % 200).otherwise(far * far * 960 + F.col("x") % 960)})
    line = line.withColumn("a", F.col("begin") + F.col("o1")).withColumn("b", F.col("a") + F.col("d"))
    # One comparison: a condition repeats all that each of its columns is made of.
    far_end = F.when(F.col("a") < F.col("bound"), F.greatest("bound", F.col("a") + 50_001))
    line = line.filter(F.col("b") < F.least("stop", far_end))
    line = line.withColumns({"k2": k + floor_div(F.col("b") - F.col("begin"), F.col("span")), "o2": F.col("b") % F.col("span")})
    turn = lambda c: F.when(F.col("alone"), F.col(f"o{c}") + 1).otherwise(_turned(f"k{c}", f"o{c}")).alias(f"pos{c}")
    one, _, two, _ = _ends()
    return line.select(one, turn(1), two, turn(2))


#: Contigs of a chromosome that takes two rounds, and copies of a line item there.
PER_STEPPED, STEPPED_COPIES = 4, 8


@stored
def stepped_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts on chromosomes of four contigs. Between the second and the third none lies within a triangle of three bins
    of 10 kb, so that a first round joins pairs and a second one, whose triangle is larger, the pairs."""
    line = _line_items(spark, sf_dir, STEPPED_COPIES)
    line = line.withColumns({"o1": F.col("number") % CONTIG_LENGTH, "d": F.when(F.col("q") <= 25, F.col("q") * 200 + F.col("x") % 200).otherwise(20_000 + (F.col("q") - 25) * 1000 + F.col("x") % 1000)})
    line = line.withColumn("a", F.col("o1") + F.col("d"))
    line = line.filter(F.col("k1") % PER_STEPPED * CONTIG_LENGTH + F.col("a") < PER_STEPPED * CONTIG_LENGTH)
    weak = (F.col("k1") % PER_STEPPED == 1) & (F.col("a") >= CONTIG_LENGTH)  # no contact reaches over a contig
    line = line.filter(~weak | (floor_div(CONTIG_LENGTH - F.col("o1"), 10_000) + floor_div(F.col("a") - CONTIG_LENGTH + 1, 10_000) >= 3))
    return line.withColumns({"k2": F.col("k1") + floor_div(F.col("a"), CONTIG_LENGTH), "o2": F.col("a") % CONTIG_LENGTH}).select(*_ends())


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted layout: chrom, ord, contig, len, orient."""
    k = F.substring("contig", 4, 12).cast("int")
    out = contigs(spark, sf_dir).withColumn("k", k)
    return out.select(F.concat(F.lit("chr"), floor_div(F.col("k"), PER_CHROMOSOME).cast("string")).alias("chrom"), (F.col("k") % PER_CHROMOSOME + 1).alias("ord"), "contig", "len", F.when(F.col("k") % 3 == 1, 1).otherwise(0).alias("orient"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sequences: letters outside the alphabet stand for N."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("seq"), F.col("doc_id").cast("string")).alias("name"), F.regexp_replace(F.translate(F.regexp_replace("text", r"\s", ""), "acgt", "ACGT"), "[^ACGT]", "N").alias("seq"))


RING = 7


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (i, j, w, code) between customers as contigs. Each seven in the order of their keys form a path; every third
    path is closed to a ring, and in every third other one the fourth contig meets both neighbours with its start."""
    name = lambda k: F.concat(F.lit("cus"), F.lpad(k.cast("string"), 8, "0"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").alias("b"))
    c = c.withColumns({"g": floor_div(F.col("k"), RING), "p": F.col("k") % RING})
    whole = c.groupBy("g").agg(F.count("*").alias("n"), F.min("p").alias("low")).filter(f"n = {RING}").select("g")
    c = c.join(whole, "g").withColumn("w", F.lit(0.5) + (F.col("k") * 7919 % 1009) / 4096.0)
    turned = F.when(F.col("g") % 3 == 1, F.when(F.col("p") == 2, 1).when(F.col("p") == 3, 0).otherwise(1)).otherwise(1)
    # Code 1: the end of i meets the start of j. Where the fourth is turned, its start meets the fifth's start.
    path = c.filter(F.col("p") < RING - 1).select(name(F.col("k")).alias("i"), name(F.col("k") + 1).alias("j"), "w", turned.alias("code"))
    ring = c.filter((F.col("p") == RING - 1) & (F.col("g") % 3 == 0)).select(name(F.col("k") - (RING - 1)).alias("i"), name(F.col("k")).alias("j"), "w", F.lit(2).alias("code"))
    return path.unionByName(ring)


def linked_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("cus"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("contig"))
