"""Steps that the scaffolding queries share: what is worked out once stays so, and small tables move instead of contacts."""

import pytest
from pyspark.sql import functions as F

from hicweave.operators import correct, layout
from hicweave.operators.tables import known, settled
from hicweave.sources import derived, text

D = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("make", [derived.contacts, derived.long_contacts, derived.stepped_contacts])
def test_contacts_are_dealt_by_contig_and_conditions_stay_short(spark, make):
    plan = optimized(make.__wrapped__(spark, D))
    assert "RepartitionByExpression [k1" in plan
    assert max(len(x) for x in plan.split("\n") if "Filter" in x) < 1500


def test_lift_moves_the_layout_and_not_the_contacts(spark):
    parts = spark.createDataFrame([("x", 1, "a", 50, 0), ("x", 2, "b", 50, 1)], "chrom string, ord int, contig string, len long, orient int")
    contacts = settled(spark.createDataFrame([("a", 3, "b", 4), ("b", 1, "c", 2)], "chr1 string, pos1 long, chr2 string, pos2 long"))
    out = layout.lift(contacts, layout.place(parts))
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.select("chr1", "pos1", "chr2", "pos2").collect()] == [("x", 3, "x", 197)]


def test_signal_is_a_table_and_meets_the_contacts_once(spark):
    counts = spark.createDataFrame([("x", 1, 3), ("x", 1, 1)], "chrom string, bin long, n int").groupBy("chrom", "bin").agg(F.sum("n").alias("down"), F.count("*").alias("up"))
    out = correct.signal(counts, spark.createDataFrame([("x", 25), ("y", 25)], "chrom string, size long"), 10)
    assert "Aggregate" not in optimized(out)
    assert sorted(tuple(r) for r in out.withColumn("s", F.round("s", 6)).collect()) == [("x", 0, 0.0), ("x", 1, 0.221849), ("x", 2, 0.0)]


def test_tables_are_not_written_twice(spark):
    t = settled(spark.range(3))
    assert known(t) is t
    assert known(t.filter("id > 0")).count() == 2


@pytest.mark.parametrize("strict", [False, True])
def test_lines_are_split_once(spark, strict):
    lines = spark.createDataFrame([("\t 0  a\t5 0 16 b 7\x0b1 60 \n",), ("0\ta\t5\t0\t16\tb\t7\t1",), ("0 a 5",), ("",), (None,)], "value string")
    out = text.contact_lines(lines, strict)
    assert optimized(out).count("split(") == 1
    want = ("0", "a", 5, "0", "16", "b", 7, "1")
    assert [tuple(r) for r in out.collect()] == [want] * (1 if strict else 2)
