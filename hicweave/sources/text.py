"""Readers and writers of the text formats. Rows of a text have no order in Spark: lines carry a number where order counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.contacts import canonical
from ..operators.stats import assembly_text, placed_lines, placed_pieces, report_lines
from ..operators.tables import numbered, running, settled

FIELDS = ["str1", "chr1", "pos1", "frag1", "str2", "chr2", "pos2", "frag2"]
AGP = "chrom string, start long, end long, ord int, tag string, contig string, contig_start string, contig_end string, orient string"


def contact_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Contacts from lines in `value`: the first eight fields between white space; strict wants exactly eight between tabs."""
    if strict:
        fields, whole = F.split("value", "\t", -1), lambda f: F.size(f) == 8
    else:
        fields, whole = F.split(F.btrim("value", F.lit(" \t\n\x0b\f\r")), r"\s+"), lambda f: F.size(f) >= 8
    # As an explode of one or no array: a filter would be pushed below the split and split each line once more.
    lines = lines.select(F.explode(F.filter(F.array(fields), whole)).alias("f"))
    kind = {"pos1": "long", "pos2": "long"}
    return lines.select(*[F.get("f", F.lit(k)).cast(kind.get(c, "string")).alias(c) for k, c in enumerate(FIELDS)])


def short_lines(contacts: DataFrame) -> DataFrame:
    return contacts.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in FIELDS]).alias("value"))


def read_contacts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return contact_lines(spark.read.text(path), strict)


def fasta_records(records: DataFrame) -> DataFrame:
    """name, len, seq from `value`, each one record; a leading sign is taken off."""
    records = records.withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substr(value, instr(value, '\n') + 1)"), r"\s", "")
    out = records.filter(F.trim("value") != "").select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("name"), F.when(F.instr("value", "\n") > 0, body).otherwise("").alias("seq"))
    return out.select("name", F.length("seq").cast("long").alias("len"), "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records are split by the reader, so that a file of many sequences is read by many tasks. A record begins with a
    sign at the beginning of a line; a sign within a header is part of it. A record is a row: two gigabytes at most."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path))


def duplicate_names(records: DataFrame) -> DataFrame:
    return records.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def read_agp(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=AGP, sep="\t", header=header)


def write_agp(agp: DataFrame, path: str) -> None:
    """Rows in order, in one file: one task writes it, what lies behind is computed by many."""
    agp.repartition(1).sortWithinPartitions("chrom", "start", "ord").write.mode("overwrite").csv(path, sep="\t", header=False)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """split, at, value: lines of the files of a path with the number of the split that they were read in, from 1 in order
    of files and places, and their place in it, from 0. A split's rows follow each other as they were read."""
    raw = spark.read.text(path).select(F.struct("_metadata.file_path", "_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("id"), "value")
    raw = settled(raw, "lines")
    splits = raw.groupBy("s").agg(F.min("id").alias("first"))
    splits = numbered(splits.select("s.file_path", "s.file_block_start", "first"), ["file_path", "file_block_start"], "split")
    splits = splits.select(F.struct("file_path", "file_block_start").alias("s"), "first", "split")
    return raw.join(splits, "s").select("split", (F.col("id") - F.col("first")).alias("at"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value: lines are counted by split, and those of the splits before are added."""
    lines = split_lines(spark, path)
    counts = lines.groupBy("split").agg(F.count("*").alias("n"))
    begins = running(counts, ["split"], {"begin": F.col("n")}).select("split", "begin")
    return lines.join(begins, "split").select((F.col("begin") + F.col("at") + 1).alias("line_no"), "value")


def read_assembly(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(idx, contig, len) and (chain, place, idx, reversed) of the .assembly text in a file, or in the files of a folder
    in the order of their names."""
    return assembly_lines(numbered_lines(spark, path))


def fasta_pieces(spark: SparkSession, path: str) -> DataFrame:
    """name, record, offset, piece: each line of sequence with the record that it belongs to and its offset there, from 0,
    and an empty piece for each record's header; records count from 1. A record of any length is read by as many tasks as its file has splits, and never a row.

    Each split finds its own headers and the lengths behind them; what lies before its first header belongs to the last
    record of a split before, which one row for each split tells.
    """
    lines = split_lines(spark, path)
    header = F.startswith("value", F.lit(">"))
    lines = lines.select("split", "at", header.alias("header"), F.when(header, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), F.when(~header, F.regexp_replace("value", r"\s", "")).alias("piece"))
    inside = Window.partitionBy("split").orderBy("at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"own": F.coalesce(F.sum(F.col("header").cast("long")).over(upto), F.lit(0)), "size": F.coalesce(F.length("piece"), F.lit(0)).cast("long")})
    before = Window.partitionBy("split", "own").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = settled(lines.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))), "pieces")
    tails = lines.groupBy("split").agg(F.max("own").alias("headers"), F.max_by("name", F.when(F.col("header"), F.col("at"))).alias("last"))
    open_ = lines.join(tails, "split").filter("own = headers").groupBy("split").agg(F.sum("size").alias("tail"))
    tails = tails.join(open_, "split")
    sums = running(tails, ["split"], {"records": F.col("headers"), "done": F.col("tail"), "marks": (F.col("headers") > 0).cast("long")})
    # Splits up to the next one with a header carry one record on: what is open there is the tails since that header.
    ends = sums.filter("headers > 0").select((F.col("marks") + 1).alias("marks"), F.col("last").alias("carried"), F.col("done").alias("since"))
    begins = sums.join(ends, "marks", "left").select("split", "records", "carried", (F.col("done") - F.col("since")).alias("ahead"))
    first = lines.filter("header").select("split", F.col("own"), F.col("name").alias("named"))
    out = lines.filter("header or size > 0").withColumn("piece", F.coalesce("piece", F.lit(""))).join(begins, "split").join(first, ["split", "own"], "left")
    return out.filter("records + own > 0").select(
        F.when(F.col("own") > 0, F.col("named")).otherwise(F.col("carried")).alias("name"), (F.col("records") + F.col("own")).alias("record"),
        F.when(F.col("own") > 0, F.col("offset")).otherwise(F.col("offset") + F.col("ahead")).alias("offset"), "piece",
    )


def fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """name, record, len of every record, from pieces: partial sums, no record in a row."""
    return lengths_of(fasta_pieces(spark, path))


def lengths_of(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("name", "record").agg(F.sum(F.length("piece")).cast("long").alias("len"))


def assembly_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, contig, len) and (chain, place, idx, reversed) from (line_no, value) of an .assembly text."""
    lines = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    f = F.split(F.expr("substr(value, 2)"), " ")
    named = lines.filter(F.startswith("value", F.lit(">"))).select(F.get(f, F.lit(1)).cast("int").alias("idx"), F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(2)).cast("long").alias("len"))
    chains = numbered(lines.filter(~F.startswith("value", F.lit(">"))), ["line_no"], "chain")
    links = chains.select("chain", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("place", "v")).withColumn("v", F.col("v").cast("int"))
    return named, links.select("chain", "place", F.abs("v").alias("idx"), (F.col("v") < 0).cast("int").alias("reversed"))


def write_sizes(sizes: DataFrame, path: str) -> None:
    sizes.repartition(1).sortWithinPartitions(*sizes.columns).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_fasta(records: DataFrame, path: str, prefix: int = 9) -> None:
    """Records by the number that ends their name."""
    ordered = records.orderBy(F.expr(f"try_cast(substr(name, {prefix + 1}) as int)"), "name")
    ordered.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """(line_no, value) as one text."""
    lines.repartition(1).sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(path)


def write_assembly(parts: DataFrame, path: str) -> None:
    """The review tool's text. Parts and chains are in order over all files of the folder."""
    assembly_text(parts).orderBy("line_no").select("value").write.mode("overwrite").text(path)


def write_report(lengths: DataFrame, path: str, shares=(50, 90, 95, 98, 99)) -> None:
    write_lines(report_lines(lengths, shares), path)


def write_sorted_contacts(contacts: DataFrame, path: str) -> None:
    """Contacts with the smaller name first, sorted by names over all files of the folder; eight fields."""
    have = set(contacts.columns)
    filled = contacts.withColumns({c: F.lit(v) for c, v in (("str1", "0"), ("frag1", "0"), ("str2", "16"), ("frag2", "1")) if c not in have})
    short_lines(canonical(filled).orderBy("chr1", "chr2", "pos1", "pos2")).write.mode("overwrite").text(path)


def write_scaffolds(placed: DataFrame, seqs: DataFrame, path: str, gap: int = 100, prefix: int = 9) -> None:
    """FASTA of whole scaffolds, by the number that ends their name, in lines of bounded size; no scaffold is ever one row."""
    pieces = placed_pieces(placed, seqs, gap).select("chrom", "ord", "piece", F.col("seq").alias("value"))
    heads = placed.select("chrom").distinct().select("chrom", F.lit(-1).alias("ord"), F.lit(0).alias("piece"), F.concat(F.lit(">"), "chrom").alias("value"))
    number = F.expr(f"try_cast(substr(chrom, {prefix + 1}) as int)")
    pieces.unionByName(heads).orderBy(number, "chrom", "ord", "piece").select("value").write.mode("overwrite").text(path)


def write_scaffold_lines(placed: DataFrame, pieces: DataFrame, path: str, gap: int = 100, prefix: int = 9) -> None:
    """The same from sequences in pieces (name, offset, piece), as fasta_pieces gives them: neither a scaffold nor a
    contig is ever one row."""
    lines = placed_lines(placed, pieces, gap)
    heads = placed.select("chrom").distinct().select("chrom", F.lit(-1).alias("ord"), F.lit(0).cast("long").alias("place"), F.concat(F.lit(">"), "chrom").alias("value"))
    number = F.expr(f"try_cast(substr(chrom, {prefix + 1}) as int)")
    lines.select("chrom", "ord", "place", "value").unionByName(heads).orderBy(number, "chrom", "ord", "place").select("value").write.mode("overwrite").text(path)


def review_bundle(contacts: DataFrame, parts: DataFrame, folder: str) -> None:
    """What the review tool opens: review.assembly, the contacts on one long scaffold, and its size."""
    from ..operators import layout

    placed = layout.place_super(parts)
    write_assembly(parts, f"{folder}/review.assembly")
    write_sorted_contacts(layout.lift(contacts, placed), f"{folder}/contacts")
    write_sizes(layout.sizes(placed), f"{folder}/sizes")


AGP_COLUMNS = ["chrom", "start", "end", "ord", "tag", "contig", "contig_start", "contig_end", "orient"]


def agp_lines(lines: DataFrame, header: bool = False) -> DataFrame:
    """Nine-column rows from lines in `value`; with a header, the line of column names goes."""
    if header:
        lines = lines.filter(~F.startswith("value", F.lit("Chromosome\t")))
    kind = dict(x.split(" ") for x in AGP.split(", "))
    f = F.split("value", "\t", -1)
    return lines.select(*[F.get(f, F.lit(k)).cast(kind[c]).alias(c) for k, c in enumerate(AGP_COLUMNS)])


def components_of(agp: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    """(chrom, ord, contig, len, orient) of the parts, on all scaffolds or those named; gap rows go."""
    parts = agp.filter("tag = 'W'")
    if chroms is not None:
        parts = parts.filter(F.col("chrom").isin(chroms))
    return parts.select("chrom", "ord", "contig", (F.col("contig_end").try_cast("long") - F.col("contig_start").try_cast("long") + 1).alias("len"), F.when(F.col("orient").isin("-", "1"), 1).otherwise(0).alias("orient"))
