"""Programs over files, by spark-submit or python -m hicweave COMMAND: `scaffold` orders contigs by their contacts;
`review` and `reviewed` go to a review tool's files and back; `sequences`, `sizes` and `lengths` tell what a layout or an
assembly holds."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import density, layout, stats
from .operators.tables import settled
from .plans import Config, Rounds, scaffold
from .sources import text


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="hicweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, say: str, **paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=say, description=say)
        p.set_defaults(run=run)
        for path, what in paths.items():
            p.add_argument(f"--{path}", required=True, help=what)
        return p

    d = Config()
    p = command("scaffold", run_scaffold, "order and orient contigs", contacts="contacts as text", fasta="sequences of the contigs", out="folder for the results")
    p.add_argument("--clusters", type=int, required=True, help="chromosomes")
    p.add_argument("--binsize", type=int, default=d.bin_size)
    p.add_argument("--cutoff", type=float, default=d.cutoff)
    p.add_argument("--triangle", type=int, default=d.triangle, help="bins of the first round's triangle")
    p.add_argument("--gap", type=int, default=d.gap)
    p.add_argument("--error-correction", action="store_true", help="break scaffolds at misjoins after each round")
    p.add_argument("--least-score", type=int, default=d.least_score, help="contacts that a contig's best pair must exceed")
    p.add_argument("--survey-least", type=int, default=d.survey_least, help="bases that a scaffold must exceed to be looked at for misjoins")
    p.add_argument("--near", type=int, default=d.near, help="least distance of the contacts that tell misjoins")
    p.add_argument("--far", type=int, default=d.far, help="largest distance of the contacts that tell misjoins")
    p.add_argument("--stop", choices=("before", "last", "two_before"), default=d.stop, help="layout to keep when a round leaves too few scaffolds")
    p.add_argument("--breaks", choices=("part", "contig"), default=d.breaks, help="whether misjoins are cut between the parts of a round or between contigs")
    p.add_argument("--resume", action="store_true", help="go on behind the whole rounds in the folder")
    p = command("review", run_review, "layout and contacts to a review tool's files", agp="final layout", contacts="contacts as text, on contigs", out="folder for the results")
    p = command("reviewed", run_reviewed, "a review tool's .assembly text to a layout", assembly=".assembly text", out="folder for the layout")
    p.add_argument("--gap", type=int, default=d.gap)
    p = command("sequences", run_sequences, "sequences of a layout's scaffolds", agp="final layout", fasta="sequences of the contigs", out="folder for the result")
    p.add_argument("--gap", type=int, default=d.gap)
    p = command("sizes", run_sizes, "sizes of a layout's scaffolds", agp="layout", out="folder for the result")
    p.add_argument("--header", action="store_true", help="the layout begins with a line of column names")
    p = command("lengths", run_lengths, "lengths at which the largest sequences hold shares of all", fasta="sequences", out="folder for the report")
    p.add_argument("--shares", type=stats.share_list, default=list(stats.SHARES), help="percentages, as 50,90")
    return top.parse_args(argv)


def config(a: argparse.Namespace) -> Config:
    return Config(
        clusters=a.clusters, bin_size=a.binsize, cutoff=a.cutoff, triangle=a.triangle, gap=a.gap, error_correction=a.error_correction,
        least_score=a.least_score, survey_least=a.survey_least, near=a.near, far=a.far, stop=a.stop, breaks=a.breaks,
    )


def run_scaffold(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes the initial layout, those of the rounds and the final one, sizes, scaffolds, lengths' report, sorted lifted
    contacts and a contact map."""
    contacts = text.read_contacts(spark, a.contacts)
    pieces = settled(text.fasta_pieces(spark, a.fasta), "pieces")
    records = settled(text.lengths_of(pieces), "records")
    if text.duplicate_names(records).limit(1).count():
        raise ValueError("names of sequences occur twice")
    contigs = records.select(F.col("name").alias("contig"), "len")
    text.write_agp(layout.initial(contigs), f"{a.out}/initial.agp")
    rounds = Rounds(f"{a.out}/rounds")
    if not a.resume:
        rounds.clear(spark)
    placed = settled(scaffold(contacts, contigs, config(a), rounds), "final")
    text.write_agp(layout.with_gaps(placed, a.gap), f"{a.out}/final.agp")
    sizes = layout.sizes(placed)
    text.write_sizes(sizes, f"{a.out}/sizes")
    text.write_report(sizes.select(F.col("size").alias("len")), f"{a.out}/report")
    text.write_scaffold_lines(placed, pieces, f"{a.out}/final.fa", a.gap)
    lifted = settled(layout.lift(contacts, placed), "lifted")
    text.write_sorted_contacts(lifted, f"{a.out}/contacts")
    chroms = sizes.select(F.col("chrom").alias("contig"), F.col("size").alias("len"))
    density.contact_map(lifted, chroms, a.binsize).write.mode("overwrite").parquet(f"{a.out}/map")


def run_review(spark: SparkSession, a: argparse.Namespace) -> None:
    text.review_bundle(text.read_contacts(spark, a.contacts), settled(text.components_of(text.read_agp(spark, a.agp)), "parts"), a.out)


def run_reviewed(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_agp(stats.layout_of_chains(*text.read_assembly(spark, a.assembly), a.gap), a.out)


def run_sequences(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_scaffold_lines(settled(text.components_of(text.read_agp(spark, a.agp)), "parts"), text.fasta_pieces(spark, a.fasta), a.out, a.gap)


def run_sizes(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_sizes(layout.sizes(text.read_agp(spark, a.agp, a.header)), a.out)


def run_lengths(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_report(text.fasta_lengths(spark, a.fasta), a.out, a.shares)


if __name__ == "__main__":
    given = arguments()
    given.run(SparkSession.builder.appName("hicweave").getOrCreate(), given)
