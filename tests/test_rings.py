"""Rings and chains side by side are ranked in as many rounds as the longest of them takes."""

from pyspark.sql import functions as F

from hicweave.operators import graph


def linked(spark, sizes, ring):
    rows, k = [], 0
    for n, closed in zip(sizes, ring):
        name = [f"n{k + x:05d}" for x in range(n)]
        rows += [(name[x], name[x + 1], 0.5 + (k + x) * 7919 % 1009 / 4096, 1) for x in range(n - 1)]
        rows += [(name[0], name[-1], 0.4, 2)] if closed else []
        k += n
    return spark.createDataFrame(rows, "i string, j string, w double, code int")


def test_rounds_follow_the_longest_ring_and_not_the_number_of_contigs(spark, monkeypatch):
    edges = linked(spark, [3, 5, 4, 2, 8] * 40, [True, True, False, False, True] * 40).cache()
    made, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name="t": made.append(name) or settled(df, name))
    arcs, rings = graph.ranked(edges)
    assert made.count("round") == 3  # 1, 2, 4, 8 links; there are 800 links
    assert rings.count() == 2 * 40 * (3 + 5 + 8)
    assert rings.filter("low.w <> 0.4").count() == 0
    assert arcs.count() == 2 * 40 * (3 + 1)
    assert {tuple(r) for r in arcs.groupBy("dist").agg(F.count("*")).collect()} == {(1, 160), (2, 80), (3, 80)}


def test_a_ring_beside_a_long_chain(spark):
    out = graph.paths(linked(spark, [3, 40, 64], [True, False, True]), spark.range(107).select(F.format_string("n%05d", "id").alias("contig")))
    assert {tuple(r) for r in out.groupBy("path").agg(F.count("*")).collect()} == {("n00000", 3), ("n00003", 40), ("n00043", 64)}
    got = {r.contig: (r.ord, r.orient) for r in out.collect()}
    assert all(got[f"n{k:05d}"] == (k + 1 - at, 0) for at, n in ((0, 3), (3, 40), (43, 64)) for k in range(at, at + n))
