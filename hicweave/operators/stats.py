"""Assembly statistics, review-tool chains and sequences."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reverse_complement
from .layout import place_chained
from .tables import numbered, running

SHARES = (50, 90, 95, 98, 99)


def share_list(text: str) -> list[int]:
    """'50,90' to numbers; only digits and commas are taken."""
    if not re.fullmatch("[0-9,]+", text):
        raise ValueError("a list of numbers is expected")
    return [int(x) for x in text.split(",") if x]


def nx(lengths: DataFrame, shares=SHARES) -> DataFrame:
    """nx, length, count: the length at which the largest sequences hold nx percent, and how many they are.

    Equal lengths are counted before the running sums, which go by ranges of lengths. Sums are decimals of 38 digits.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    by = lengths.groupBy(F.col("len").cast("long").alias("len")).agg(F.count("*").alias("n"))
    run = running(by, [F.desc("len")], {"c": F.col("n"), "s": wide(F.col("n") * wide(F.col("len")))})
    total = int(by.agg(F.sum(wide(F.col("n") * wide(F.col("len"))))).collect()[0][0] or 0)  # one number
    run = run.withColumn("nx", F.explode(F.array(*[F.lit(int(x)) for x in shares])))
    short = wide(wide(F.col("nx")) * wide(F.lit(total))) - wide(100 * wide(F.col("s")))
    run = run.withColumn("short", wide(short))
    more = F.call_function("div", wide(F.col("short") + wide(100 * wide(F.col("len")))) - 1, wide(100 * wide(F.col("len"))))
    hit = run.filter((F.col("short") > 0) | (F.col("c") == 0)).withColumn("more", F.least(F.greatest(more, F.lit(1)), F.col("n")))
    hit = hit.groupBy("nx").agg(F.max_by(F.struct("len", (F.col("c") + F.col("more")).alias("count")), "c").alias("m"))
    return hit.select("nx", F.col("m.len").alias("length"), F.col("m.count").cast("long").alias("count"))


def report_lines(lengths: DataFrame, shares=SHARES) -> DataFrame:
    """line_no, value: the report on lengths, as it is written to a file."""
    head = totals(lengths).select(F.lit(0).alias("line_no"), F.format_string("# Total size:%d\t Total scaffolds: %d", F.coalesce("total", F.lit(0)), "sequences").alias("value"))
    names = head.select(F.lit(1).alias("line_no"), F.lit("# Nx\tLength\tL").alias("value"))
    rows = nx(lengths, shares).select((F.lit(2) + F.array_position(F.array(*[F.lit(int(x)) for x in shares]), F.col("nx"))).cast("int").alias("line_no"), F.format_string("N%d\t%d\t%d", "nx", "length", "count").alias("value"))
    return head.unionAll(names).unionAll(rows)


def totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.sum("len").alias("total"), F.count("*").alias("sequences"), F.max("len").alias("longest"))


def indexed(parts: DataFrame) -> DataFrame:
    """Adds idx: parts count on over all scaffolds, in order of their names."""
    return numbered(parts, ["chrom", "ord"], "idx")


def chains(parts: DataFrame) -> DataFrame:
    """chrom, chain: signed indices of a scaffold's parts."""
    signed = indexed(parts).withColumn("v", F.when(F.col("orient") == 1, -F.col("idx")).otherwise(F.col("idx")))
    return signed.groupBy("chrom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "v"))), lambda x: x["v"].cast("string")), " ").alias("chain"))


def assembly_text(parts: DataFrame) -> DataFrame:
    """line_no, value: an .assembly text: a line for each part with its index and length, then a chain for each scaffold."""
    named = indexed(parts).select(F.lit(0).alias("kind"), F.col("idx").alias("at"), F.concat(F.lit(">"), F.concat_ws(" ", "contig", F.col("idx").cast("string"), F.col("len").cast("string"))).alias("value"))
    lines = numbered(chains(parts), ["chrom"], "at").select(F.lit(1).alias("kind"), "at", F.col("chain").alias("value"))
    return numbered(named.unionAll(lines), ["kind", "at"], "line_no").select("line_no", "value")


def from_chains(named: DataFrame, links: DataFrame) -> DataFrame:
    """(chrom, ord, contig, len, orient) from .assembly rows."""
    return links.join(named, "idx").select(F.concat(F.lit("chain"), F.col("chain").cast("string")).alias("chrom"), (F.col("place") + 1).alias("ord"), "contig", "len", F.col("reversed").alias("orient"))


def layout_of_chains(named: DataFrame, links: DataFrame, gap: int = 100) -> DataFrame:
    """Nine-column rows of .assembly rows: parts and gaps in the order of their chains, scaffolds by falling size, of
    equals the earlier chain first."""
    rows = place_chained(from_chains(named, links), gap)
    ends = rows.groupBy("chrom").agg(F.max("end").alias("size")).withColumn("chain", F.substring("chrom", 6, 20).cast("long"))
    names = numbered(ends, [F.desc("size"), F.asc("chain")]).select("chrom", F.concat(F.lit("scaffold_"), F.col("number").cast("string")).alias("name"))
    return rows.join(names, "chrom").select(F.col("name").alias("chrom"), *rows.columns[1:])


def joined_sequences(placed: DataFrame, seqs: DataFrame, gap: int = 100) -> DataFrame:
    """chrom, seq: sequences of parts in order, reversed ones complemented, N between."""
    part = placed.join(seqs.select(F.col("name").alias("contig"), "seq"), "contig")
    part = part.withColumn("seq", F.when(F.col("orient") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "seq"))), lambda x: x["seq"])
    return part.groupBy("chrom").agg(F.array_join(ordered, "N" * gap).alias("seq"))


def placed_pieces(placed: DataFrame, seqs: DataFrame, gap: int = 100, size: int = 1 << 16) -> DataFrame:
    """chrom, ord, piece, seq: the sequences of scaffolds in pieces of bounded size: parts, reversed ones complemented, cut
    into pieces, and a piece of N behind each part but the last. Joined in order they are what joined_sequences gives,
    which holds a scaffold in one row and so has to stay under two gigabytes."""
    last = placed.groupBy("chrom").agg(F.max("ord").alias("_last"))
    part = placed.join(seqs.select(F.col("name").alias("contig"), "seq"), "contig").join(last, "chrom")
    part = part.withColumn("seq", F.when(F.col("orient") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size)), lambda a: F.substring(F.col("seq"), a + 1, F.lit(size)))
    pieces = F.when(F.col("ord") < F.col("_last"), F.concat(cut, F.array(F.lit("N" * gap)))).otherwise(cut)
    return part.select("chrom", "ord", F.posexplode(pieces).alias("piece", "seq"))


def placed_lines(placed: DataFrame, pieces: DataFrame, gap: int = 100) -> DataFrame:
    """chrom, ord, place, value: the pieces (name, offset, piece) of contigs where they lie on scaffolds, reversed ones
    complemented and in falling order, and N behind each contig but the last. Ordered, they are the scaffolds."""
    last = placed.groupBy("chrom").agg(F.max("ord").alias("_last"))
    part = placed.join(last, "chrom").select("chrom", "ord", "contig", "orient", "_last")
    at = part.join(pieces.filter("piece <> ''").select(F.col("name").alias("contig"), "offset", "piece"), "contig")
    turned = F.col("orient") == 1
    lines = at.select("chrom", "ord", F.when(turned, -F.col("offset") - 1).otherwise(F.col("offset")).alias("place"), F.when(turned, reverse_complement(F.col("piece"))).otherwise(F.col("piece")).alias("value"))
    gaps = part.filter("ord < _last").select("chrom", "ord", F.lit((1 << 63) - 1).alias("place"), F.lit("N" * gap).alias("value"))
    return lines.unionByName(gaps) if gap else lines


def chunks(seqs: DataFrame, size: int) -> DataFrame:
    """name, seq: pieces of size, named by name, start and end (from 0); pieces of N alone are left out."""
    at = seqs.filter(F.length("seq") > 0).select("name", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(size))).alias("a"))
    out = at.select(F.concat_ws("_", "name", F.col("a").cast("string"), F.least(F.col("a") + size, F.length("seq")).cast("string")).alias("name"), F.substring("seq", F.col("a") + 1, F.lit(size)).alias("seq"))
    return out.filter(F.translate("seq", "Nn", "") != "")
