"""Misjoins that a later round sees lie within blocks of an earlier one."""

from dataclasses import replace

import pytest
from test_units import chromosomes, planted

from hicweave import plans
from hicweave.operators import correct, layout
from hicweave.operators.tables import settled
from hicweave.plans import Config, scaffold

CONFIG = Config(clusters=4, bin_size=2000, triangle=5, error_correction=True, near=1000, far=12_000, survey_least=200_000)
PARTS = "chrom string, ord int, contig string, len long, orient int"


def test_breaks_at_contigs_do_not_depend_on_the_blocks_of_earlier_rounds(spark, monkeypatch):
    """A misjoin near the fourth contig's end is cut there, also where the round has joined blocks of two and five."""
    contacts, _, order = planted(spark, [7, 4])
    monkeypatch.setattr(correct, "break_points", lambda signals: spark.createDataFrame([("X0", 79.5)], "chrom string, break_bin double"))
    fine = [(f"X{x}", k + 1, c, 40_000, o) for x, part in enumerate(order) for k, (c, o) in enumerate(part)]
    want = [order[0][:4], order[0][4:], order[1]]
    assert chromosomes(plans.corrected(contacts, spark.createDataFrame(fine, PARTS), CONFIG)) == want
    child = spark.createDataFrame([("C" if x == "X1" else "A" if k <= 2 else "B", k - 2 if x == "X0" and k > 2 else k, c, n, o) for x, k, c, n, o in fine], PARTS)
    parent = spark.createDataFrame([("X0", 1, "A", 80_100, 0), ("X0", 2, "B", 200_400, 0), ("X1", 1, "C", 160_300, 0)], PARTS)
    now = settled(layout.lift(contacts, layout.place(child)))
    assert chromosomes(plans.corrected(now, parent, CONFIG, layout.inside(child, parent))) == want
    parts = plans.corrected(now, parent, CONFIG)  # by default between the round's parts alone
    assert chromosomes(layout.compose(child, parts)) == [order[0][:2], order[0][2:], order[1]]


def test_a_contig_between_two_breaks_lies_forward(spark, monkeypatch):
    contacts, _, order = planted(spark, [7, 4])
    monkeypatch.setattr(correct, "break_points", lambda signals: spark.createDataFrame([("X0", 61.0), ("X0", 81.0)], "chrom string, break_bin double"))
    fine = spark.createDataFrame([(f"X{x}", k + 1, c, 40_000, int(k % 3 == 0)) for x, part in enumerate(order) for k, (c, _) in enumerate(part)], PARTS)
    turned = [[(c, int(k % 3 == 0)) for k, (c, _) in enumerate(part)] for part in order]
    got = chromosomes(plans.corrected(contacts, fine, CONFIG, fine))
    assert got == [turned[0][:3], [(order[0][3][0], 0)], turned[0][4:], turned[1]]
    assert chromosomes(plans.corrected(contacts, fine, CONFIG)) == [turned[0][:3], turned[0][3:4], turned[0][4:], turned[1]]


def test_a_run_that_breaks_at_contigs(spark, tmp_path):
    contacts, contigs, order = planted(spark, [7, 4])
    config = replace(CONFIG, breaks="contig")
    got = chromosomes(scaffold(contacts, contigs, config, plans.Rounds(str(tmp_path / "r"))))
    assert sorted(c for x in got for c, _ in x) == sorted(c for x in order for c, _ in x)
    assert chromosomes(scaffold(contacts, contigs, config, plans.Rounds(str(tmp_path / "r")))) == got  # from the rounds in the folder
    with pytest.raises(ValueError):
        replace(CONFIG, breaks="bin")


def test_scaffolds_outside_a_round_stay(spark):
    child = spark.createDataFrame([("A", 1, "a", 9, 0), ("A", 2, "b", 9, 1), ("c", 1, "c", 9, 0)], PARTS)
    parts = spark.createDataFrame([("X_break_1", 1, "b", 9, 1), ("X_break_2", 1, "a", 9, 0)], PARTS)
    assert chromosomes(layout.renewed(child, parts)) == [[("a", 0)], [("b", 1)], [("c", 0)]]
