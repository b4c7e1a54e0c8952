"""A run meets its contacts as seldom as it can: what it knows is not worked out again, what cannot count is left alone."""

import numpy as np
from pyspark.sql import functions as F
from test_units import planted

from hicweave import plans
from hicweave.operators import correct, density, layout, score
from hicweave.operators.tables import met, settled
from hicweave.plans import Config, Misjoins

CONFIG = Config(bin_size=2000, triangle=5, error_correction=True, near=1000, far=12_000, survey_least=200_000, breaks="contig")


def parts(spark, order, name):
    return spark.createDataFrame([(f"{name}{x}", k + 1, c, 40_000, o) for x, part in enumerate(order) for k, (c, o) in enumerate(part)], "chrom string, ord int, contig string, len long, orient int")


def test_a_scaffold_is_looked_at_once_whatever_its_name(spark, monkeypatch):
    contacts, _, order = planted(spark, [7, 6])
    looked, old = [], correct.surveyed
    monkeypatch.setattr(correct, "surveyed", lambda c, placed, least: looked.append(sorted({r.chrom for r in placed.select("chrom").collect()})) or old(c, placed, least))
    # The signal of every scaffold that is looked at, in place of its breaks.
    monkeypatch.setattr(correct, "break_points", lambda s: s.groupBy("chrom").agg(F.round(F.sum(F.col("s") * F.col("bin")), 6).alias("break_bin")))
    told = lambda df: {r.chrom: r.break_bin for r in df.collect()}
    misjoins = Misjoins(contacts, CONFIG)
    first = told(misjoins.points(parts(spark, order, "A")))
    assert told(misjoins.points(parts(spark, order, "B"))) == {"B0": first["A0"], "B1": first["A1"]}
    other = [order[0], [(c, 1 - o) for c, o in reversed(order[1])]]  # one of them turned
    turned = told(misjoins.points(parts(spark, other, "C")))
    assert turned == told(Misjoins(contacts, CONFIG).points(parts(spark, other, "C"))) and turned["C0"] == first["A0"]
    assert looked == [["A0", "A1"], ["C1"], ["C0", "C1"]]


def test_only_scaffolds_that_share_contacts_are_lifted(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("c", "zz")], "chr1 string, chr2 string")
    whole = spark.createDataFrame([("X", "a"), ("X", "b"), ("Y", "c"), ("Z", "d"), ("Z", "e"), ("f", "f")], "chrom string, contig string")
    assert sorted(r.chrom for r in plans.crossing(pairs, whole).collect()) == ["X", "Y"]


def test_densities_by_a_profile(spark):
    contacts = spark.createDataFrame([("a", 3, "a", 7), ("a", 11, "a", 99), ("a", 25, "a", 26), ("a", 40, "a", 41), ("b", 1, "b", 2), ("a", 1, "b", 1), ("z", 1, "z", 1)], "chr1 string, pos1 long, chr2 string, pos2 long")
    contigs = spark.createDataFrame([("a", 25), ("b", 9)], "contig string, len long")
    with_it = density.profiled(contacts, contigs, 10)
    for make in (lambda c: density.diagonal(c, contigs, 10), lambda c: density.ends(c, contigs.filter("len > 9"), 10, 2)):
        assert sorted(map(tuple, make(with_it).collect())) == sorted(map(tuple, make(contacts).collect()))
    assert sorted(map(tuple, density.diagonal(with_it, contigs, 10).collect())) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 1), ("b", 0, 1)]
    assert "_profile" not in vars(contacts)


def test_scores_are_those_of_all_cells(spark):
    """Dense bins with holes, on contigs of any length: against every contact in every cell."""
    rng = np.random.default_rng(5)
    lengths = {"a": 95, "b": 61, "c": 140}
    pick = lambda: str(rng.choice(list(lengths)))
    rows = [(x, int(rng.integers(1, lengths[x] + 5)), y, int(rng.integers(1, lengths[y] + 5))) for x, y in ((pick(), pick()) for _ in range(3000))]
    dense = [(c, e, b, float(rng.integers(1, 9)) / 4, k) for c in lengths for e in (0, 1) for k, b in enumerate(sorted(rng.choice(12, 5, replace=False).tolist()))]
    weight, want = {(c, e, b): (w, k) for c, e, b, w, k in dense}, {}
    for x, p, y, q in rows:
        if x == y:
            continue
        x, p, y, q = (x, p, y, q) if x < y else (y, q, x, p)
        bins = lambda c, at: [(0, min(at, lengths[c]) // 10), (1, (lengths[c] - min(at, lengths[c]) + 1) // 10)]
        for ex, bx in bins(x, p):
            for ey, by in bins(y, q):
                (w, r), (v, s) = weight.get((x, ex, bx), (0, 9)), weight.get((y, ey, by), (0, 9))
                if r + s < 3:
                    want[x, y, ex + 2 * ey] = want.get((x, y, ex + 2 * ey), 0) + w * v
    contacts = spark.createDataFrame(rows, "chr1 string, pos1 long, chr2 string, pos2 long")
    got = score.triangle(contacts, spark.createDataFrame(list(lengths.items()), "contig string, len long"), spark.createDataFrame(dense, "contig string, e int, bin long, w double, rank int"), 10, 3)
    assert {(r.x, r.y, r.code): r.score for r in got.collect()} == {k: round(v) for k, v in want.items()} and len(want) > 6


def test_names_are_met_by_hashes_and_compared(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "at string, v int")
    right = settled(spark.createDataFrame([("a",), ("c",), (None,)], "name string"))
    out = met(left, right, "at", "name")
    assert sorted(r.v for r in out.collect()) == [1, 4] == sorted(r.v for r in met(left, right, "at", "name", "left_semi").collect())
    assert "xxhash64" in layout.lift(left.selectExpr("at as chr1", "v as pos1", "at as chr2", "v as pos2"), layout.place(parts(spark, [[("a", 0)]], "X")))._jdf.queryExecution().executedPlan().toString()
