"""Densities of contacts that keep arriving. Counts add up, so that a stream needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import floor_div
from ..operators.contacts import intra
from ..sources.text import contact_lines


def diagonal_counts(contacts: DataFrame, bin_size: int) -> DataFrame:
    """contig, bin, n so far; for an output mode of update or complete."""
    b1, b2 = floor_div(F.col("pos1"), bin_size), floor_div(F.col("pos2"), bin_size)
    return intra(contacts).filter(b1 == b2).groupBy(F.col("chr1").alias("contig"), b1.alias("bin")).agg(F.count("*").alias("n"))


def contact_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts of text files as they come into a folder."""
    return contact_lines(spark.readStream.text(folder))
