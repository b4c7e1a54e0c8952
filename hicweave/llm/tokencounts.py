"""Token counts of documents in flat token files that have no index: a scan for the end-of-document id.

A file is nothing but 16-bit ids, documents one after the other, each with an end id after it; the end id's name in a
text is text like any other, so that the id occurs nowhere else. Files are read in blocks
that know nothing of documents; a block finds its end ids with one vectorised comparison. A document may begin in any
earlier block: a prefix scan over the blocks' last end ids and counts, within groups of blocks and then over groups,
tells each block where its first document began and how many documents came before. Tokens after the last end id of a
file are a document too. Ids of documents are neither needed nor kept: a document is named by shard and place. Null texts are empty documents of no token; an empty table has no files and no documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table, trimmed
from .tokens import Ids

END = 50256
BLOCK = 1 << 20
#: Blocks that are scanned together before groups are.
GROUP = 1024


def write_flat(df: DataFrame, vocabulary: str, to: str, end: int = END) -> DataFrame:
    """Writes one token file for each partition of df into the folder `to`, which executors must share, and returns
    (file, shard, bytes). A repeated task writes a file of its own; only those in the result belong to the data."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        coder, stop = Ids(vocabulary, special=False), int(end).to_bytes(2, "little")
        store, folder = fs.FileSystem.from_uri(to)
        store.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        name, size = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex}.bin", 0
        with store.open_output_stream(name) as out:
            for batch in batches:
                for t in batch.column(0):
                    ids = coder(t.as_py() or "") + stop
                    out.write(ids)
                    size += len(ids)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard], pa.int32()), pa.array([size], pa.int64())], ["file", "shard", "bytes"])

    return df.select("text").mapInArrow(run, "file string, shard int, bytes bigint")


def separators(files: DataFrame, root: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(shard, block, k, at): places of end ids, numbered within their block; the end of a file counts if a document
    is open there."""
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {block}"))))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, shard, size, k in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(name) as f:
                    data = f.read_at(min(block, size - k * block), k * block)
                ids = np.frombuffer(data, "<u2")
                at = np.flatnonzero(ids == end) + k * (block // 2)
                if (k + 1) * block >= size and ids[-1] != end:
                    at = np.append(at, size // 2)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([k] * n, pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(at, pa.int64())], ["shard", "block", "k", "at"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("file", "shard", "bytes", "block").repartition(parts, "shard", "block")
    return dealt.mapInArrow(run, "shard int, block bigint, k bigint, at bigint")


def stitched(marks: DataFrame) -> DataFrame:
    """(shard, document, start, n_tokens) from the end ids of blocks."""
    blocks = marks.groupBy("shard", "block").agg(F.count("*").alias("n"), F.max("at").alias("last")).withColumn("group", F.expr(f"block div {GROUP}"))
    inside = Window.partitionBy("shard", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"before": F.coalesce(F.sum("n").over(inside), F.lit(0)), "began": F.max("last").over(inside)})
    groups = blocks.groupBy("shard", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("shard", "group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("group_before"), F.max("last").over(over).alias("group_began"))
    carried = blocks.join(groups, ["shard", "group"]).select("shard", "block", (F.col("before") + F.col("group_before")).alias("before"), F.coalesce("began", "group_began", F.lit(-1)).alias("began"))
    previous = F.lag("at").over(Window.partitionBy("shard", "block").orderBy("k"))
    out = marks.withColumn("previous", previous).join(carried, ["shard", "block"])
    start = F.coalesce("previous", "began") + 1
    return out.select("shard", (F.col("before") + F.col("k")).alias("document"), start.alias("start"), (F.col("at") - start).alias("n_tokens"))


def count_tokens(files: DataFrame, root: str, end: int = END, block: int = BLOCK) -> DataFrame:
    return stitched(materialise(separators(files, root, end, block), "ends"))


def query(spark, sf_dir: str) -> DataFrame:
    """Token files are derived from the documents first; the scan then knows only the files."""
    import public_tokenizers

    root = f"{shared_dir(spark)}/hicweave-flat-{uuid.uuid4().hex}"
    files = materialise(write_flat(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), root), "files")
    return count_tokens(files, root)
