"""Tables between steps, and sums over an order of all rows that no single task sees."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets one of its own; on a cluster each
    machine would have another, so an error is raised."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        found = os.environ.setdefault("HICWEAVE_SHARED_DIR", tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return found.rstrip("/")


#: Paths of the tables that were made within each open scratch().
_SCRATCH: list[dict[int, tuple[DataFrame, str]]] = []


@contextmanager
def scratch():
    """Tables that are settled inside go at the end, but those that are given to the function that this yields. What is
    derived from the others has to be a table by then."""
    made: dict[int, tuple[DataFrame, str]] = {}
    kept: set[int] = set()
    _SCRATCH.append(made)
    try:
        yield lambda *tables: kept.update(map(id, tables))
    finally:
        _SCRATCH.remove(made)
        for k, (df, path) in made.items():
            if k not in kept:
                _delete(df.sparkSession, path)
            elif _SCRATCH:
                _SCRATCH[-1][k] = (df, path)


def _delete(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor loses none of it."""
    path = f"{shared_folder(df.sparkSession)}/hicweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _SCRATCH:
        _SCRATCH[-1][id(out)] = (out, path)
    out._settled = True
    return out


def known(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table: itself, if settled made it."""
    return df if getattr(df, "_settled", False) else settled(df, name)


def spent(*tables: DataFrame) -> None:
    """Removes tables made by settled, once what was derived from them is a table itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/hicweave-" in folder:
                _delete(spark, folder)


def met(df: DataFrame, other: DataFrame, at: str, name: str, how: str = "inner") -> DataFrame:
    """df joined to other where the texts in df's column `at` and in other's column `name` are the same. They are met by
    their hashes, as whole numbers are looked up several times faster than texts, and compared where these agree: two
    inequalities, as an equality would become a key. Nulls meet nothing."""
    same = (F.xxhash64(at) == F.xxhash64(name)) & (F.col(at) <= F.col(name)) & (F.col(at) >= F.col(name))
    return df.join(other, same, how)


def running(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of sums, the sum over all rows before in the given order, which should be total.

    Rows are dealt by ranges of the order, which are written down before they are used twice; each range sums for
    itself, and sums over the ranges before are added: one row for each range, as many as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v{k}": v for k, v in enumerate(sums.values())}
    dealt = settled(df.withColumns(values).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_t{k}") for k, v in enumerate(values)])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("_range", *[F.coalesce(F.sum(f"_t{k}").over(ahead), F.lit(0)).alias(f"_b{k}") for k in range(len(values))])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({f"_w{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in enumerate(values)})
    joined = within.join(begins, "_range")
    return joined.select(*df.columns, *[(F.col(f"_w{k}") + F.col(f"_b{k}")).alias(name) for k, name in enumerate(sums)])


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Adds the place of each row in the given order, from 1."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share, value: exact quantiles of a column's values that are not null, interpolated between neighbours; no row if
    there are none. Equal values are counted, the counts are summed up by ranges of values, and of all values only the one
    or two at each share's place are taken: no task holds them all."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    run = settled(running(counts, ["value"], {"before": F.col("n")}), "quantiles")
    total = run.agg(F.max(F.col("before") + F.col("n"))).collect()[0][0] or 0  # one number
    wanted = df.sparkSession.createDataFrame([(float(s), int(k), s * (total - 1) - int(s * (total - 1))) for s in shares for k in [s * (total - 1)] if total], "share double, k long, part double")
    places = wanted.select("share", "part", "k", F.explode(F.array("k", F.least(F.col("k") + 1, F.lit(total - 1)))).alias("place"))
    # As many places as shares, twice, against ranges of counts.
    met = run.join(F.broadcast(places), (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    low, high = F.max(F.when(F.col("place") == F.col("k"), F.col("value"))), F.max(F.when(F.col("place") == F.least(F.col("k") + 1, F.lit(total - 1)), F.col("value")))
    return met.groupBy("share", "part").agg(low.alias("low"), high.alias("high")).select("share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).cast("double").alias("value"))
