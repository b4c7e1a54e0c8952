"""Hand-sized cases of the scaffolding operators, and data with a planted answer."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hicweave import plans
from hicweave.functions import floor_div, half, reverse_complement, transposed
from hicweave.operators import contacts, correct, density, graph, layout, score, stats
from hicweave.operators.tables import numbered, quantiles, running, scratch, settled
from hicweave.plans import Config, scaffold
from hicweave.sources import text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_triangle_counts_cells_below_the_diagonal(spark):
    contigs = spark.createDataFrame([("a", 100), ("b", 100)], "contig string, len long")
    contacts = spark.createDataFrame([("a", 5, "b", 5), ("a", 5, "b", 15), ("a", 15, "b", 5), ("a", 15, "b", 15)], "chr1 string, pos1 long, chr2 string, pos2 long")
    dense = spark.createDataFrame([(c, 0, b, 1.0, b) for c in "ab" for b in (0, 1)], "contig string, e int, bin long, w double, rank int")
    assert rows(score.triangle(contacts, contigs, dense, 10, 2)) == [("a", "b", 0, 3)]


def test_ranks_close_up_over_thin_bins(spark):
    ends = spark.createDataFrame([("a", 0, 0, 50), ("a", 0, 1, 3), ("a", 0, 2, 40)], "contig string, e int, bin long, n long")
    assert [(r.bin, r.rank) for r in density.flagged(ends, 100.0).orderBy("bin").collect()] == [(0, 0), (2, 1)]


def test_end_density_counts_by_the_first_position(spark):
    contigs = spark.createDataFrame([("a", 99)], "contig string, len long")
    contacts = spark.createDataFrame([("a", 35, "a", 75)], "chr1 string, pos1 long, chr2 string, pos2 long")
    assert rows(density.ends(contacts, contigs, 10, 3)) == [("a", 0, 3, 1), ("a", 1, 6, 1)]
    assert density.diagonal(contacts, contigs, 10).agg(F.sum("n")).collect()[0][0] == 0


def test_swapped_names_swap_codes(spark):
    df = spark.range(4).select(transposed(F.col("id").cast("int")).alias("c"))
    assert [r.c for r in df.collect()] == [0, 2, 1, 3]


@pytest.mark.parametrize(("most", "kept"), [(30, 0), (31, 2)])
def test_rows_need_more_than_the_limit(spark, most, kept):
    best = spark.createDataFrame([("a", "b", most, 0)], "x string, y string, score long, code int")
    assert score.normalised(best).count() == kept


def test_denominator_is_the_largest_five(spark):
    best = spark.createDataFrame([("a", f"b{k}", s, 0) for k, s in enumerate([100, 90, 80, 70, 60, 50])], "x string, y string, score long, code int")
    got = {r.j: r.v for r in score.normalised(best).filter("i = 'a'").collect()}
    assert got["b0"] == float(np.float16(100 / 400))
    assert got["b5"] == float(np.float16(50 / 400))


def test_half_precision(spark):
    values = [float(x) for x in np.random.default_rng(1).random(500)] + [0.0, 1e-6, 0.3]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", half(F.col("v")).alias("h")).collect()
    assert all(r.h == float(np.float16(r.v)) for r in got)


def walk(links: pd.DataFrame) -> list[list[str]]:
    """Paths of one component, from links (i, j, w, code) with i < j. A cycle loses its weakest link; where a contig
    would meet both neighbours with the same end, it becomes a path of its own."""
    rows = {(a, b): (w, c) for a, b, w, c in links[["i", "j", "w", "code"]].itertuples(index=False)}
    near: dict[str, list[str]] = {}
    for a, b in rows:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    if all(len(x) == 2 for x in near.values()):
        a, b = min(rows, key=lambda k: (rows[k][0], k))
        near[a].remove(b)
        near[b].remove(a)
    path, last = [min(n for n, x in near.items() if len(x) == 1)], None
    while following := [n for n in near[path[-1]] if n != last]:
        last = path[-1]
        path.append(following[0])
    out, part, k = [], [path[0]], 1
    while k < len(path):
        if k + 1 < len(path) and len(part) and part[-1] == path[k - 1] and not (code(rows, path[k - 1], path[k]) >> 1 ^ code(rows, path[k], path[k + 1])) & 1:
            out += [part, [path[k]]]
            part = [path[k + 1]]
            k += 2
            continue
        part.append(path[k])
        k += 1
    return [p for p in [*out, part] if p]


def code(rows: dict, a: str, b: str) -> int:
    """Ends by which a (bit 0) and b (bit 1) meet."""
    if (a, b) in rows:
        return int(rows[a, b][1])
    c = int(rows[b, a][1])
    return c if c in (0, 3) else 3 - c


def oriented(path: list[str], rows: dict) -> list[int]:
    """1 for contigs that lie reversed: a path leaves its first contig by one end and enters each other by one."""
    if len(path) == 1:
        return [0]
    first = 0 if code(rows, path[0], path[1]) & 1 else 1
    return [first, *(code(rows, a, b) >> 1 & 1 for a, b in zip(path, path[1:]))]


def links(*x):
    return pd.DataFrame(x, columns=["i", "j", "w", "code"])


def test_cycle_loses_its_weakest_link():
    assert walk(links(("a", "b", 0.9, 1), ("b", "c", 0.8, 1), ("a", "c", 0.4, 2))) == [["a", "b", "c"]]


def test_conflict_makes_single_paths():
    # b meets both neighbours with its start.
    assert sorted(walk(links(("a", "b", 0.9, 1), ("b", "c", 0.8, 0)))) == [["a"], ["b"], ["c"]]


@pytest.mark.parametrize("seed", range(2))
def test_paths_against_a_walk(spark, seed):
    """Chains and rings of every length with random ends: the walk of plain loops, without a Python worker."""
    rng = np.random.default_rng(seed)
    rows_, nodes, want, at = [], [], [], 0
    for n in [1, 2, 3, 3, 4, 5, 6, 7, 9, 14, 30, 33] + [3, 4, 5, 8, 17]:
        ring = len(nodes) > 110
        own = [f"n{k:03d}" for k in rng.permutation(np.arange(at, at + n))]
        at += n
        nodes += own
        pairs = list(zip(own, own[1:])) + ([(own[-1], own[0])] if ring else [])
        mine = [(min(p), max(p), float(rng.integers(1, 4)), int(rng.integers(0, 4))) for p in pairs]
        rows_ += mine
        known = {(a, b): (w, c) for a, b, w, c in mine}
        parts = walk(pd.DataFrame(mine, columns=["i", "j", "w", "code"])) if mine else [own]
        want += [(min(p), k + 1, c, o) for p in parts for k, (c, o) in enumerate(zip(p, oriented(p, known)))]
    e = spark.createDataFrame(rows_, "i string, j string, w double, code int")
    found = graph.paths(settled(e), spark.createDataFrame([(n,) for n in nodes], "contig string"))
    assert rows(found) == sorted(want)
    assert not any(x in found._jdf.queryExecution().toString() for x in ("InPandas", "InArrow", "Python"))


def test_a_chain_of_many_contigs(spark):
    n = 100_000
    e = spark.range(n - 1).select(F.format_string("c%06d", "id").alias("i"), F.format_string("c%06d", F.col("id") + 1).alias("j"), F.lit(1.0).alias("w"), F.lit(1).alias("code"))
    got = graph.paths(settled(e), spark.range(n).select(F.format_string("c%06d", "id").alias("contig")))
    r = got.agg(F.count("*").alias("n"), F.countDistinct("path").alias("p"), F.count_if(F.col("ord") == F.substring("contig", 2, 6).cast("int") + 1).alias("ok"), F.max("orient").alias("o")).collect()[0]
    assert (r.n, r.p, r.ok, r.o) == (n, 1, n, 0)


def test_layout_and_lift(spark):
    parts = spark.createDataFrame([("s", 1, "c1", 100, 0), ("s", 2, "c2", 50, 1)], "chrom string, ord int, contig string, len long, orient int")
    placed = layout.place(parts, 10)
    assert [(r.start, r.end) for r in placed.orderBy("ord").collect()] == [(1, 100), (111, 160)]
    c = spark.createDataFrame([("c1", 5, "c2", 5), ("c1", 5, "zz", 5)], "chr1 string, pos1 long, chr2 string, pos2 long")
    assert [(r.pos1, r.pos2) for r in layout.lift(c, placed).collect()] == [(5, 156)]
    assert [(r.start, r.end) for r in layout.place_joined(parts).orderBy("ord").collect()] == [(1, 100), (100, 150)]


def test_composition_turns_reversed_blocks(spark):
    schema = "chrom string, ord int, contig string, len long, orient int"
    child = spark.createDataFrame([("A", 1, "c1", 10, 0), ("A", 2, "c2", 10, 1), ("B", 1, "c3", 10, 0)], schema)
    parent = spark.createDataFrame([("P", 1, "A", 20, 1)], schema)
    got = sorted((r.chrom, r.ord, r.contig, r.orient) for r in layout.compose(child, parent).collect())
    assert got == [("B", 1, "c3", 0), ("P", 1, "c2", 0), ("P", 2, "c1", 1)]


def test_nx(spark):
    got = stats.nx(spark.createDataFrame([(50,), (30,), (20,)], "len long"), (50, 90))
    assert rows(got) == [(50, 50, 1), (90, 20, 3)]
    assert stats.share_list("50,90") == [50, 90]
    with pytest.raises(ValueError):
        stats.share_list("50;90")


def test_nx_of_large_genomes(spark):
    lengths = [3_000_000_000_000_000_000, 3_000_000_000_000_000_000, 7, 1]
    got = rows(stats.nx(spark.createDataFrame([(n,) for n in lengths], "len long"), (50, 90, 100)))
    assert got == [(50, lengths[0], 2), (90, lengths[0], 2), (100, 1, 4)]
    ints = [24_783_473 // 30 + k for k in range(30)]
    got = {r.nx: (r.length, r["count"]) for r in stats.nx(spark.createDataFrame([(n,) for n in ints], "len int")).collect()}
    down, total = sorted(ints, reverse=True), sum(ints)
    for share, found in got.items():
        k = next(k for k in range(1, 31) if 100 * sum(down[:k]) >= share * total)
        assert found == (down[k - 1], k)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbers_and_sums_over_all_rows(spark, n):
    df = spark.createDataFrame([(k * 7919 % 1009, k % 3) for k in range(n)], "k long, v long")
    want, done = [], 0
    for place, r in enumerate(sorted(df.collect(), key=lambda r: -r.k)):
        want.append((r.k, r.v, done, place))
        done += r.v
    assert rows(running(df, [F.desc("k")], {"sum": F.col("v"), "place": F.lit(1).cast("long")})) == sorted(want)
    assert sorted(r.number for r in numbered(df, ["k"]).collect()) == list(range(1, n + 1))


def test_scratch_tables_go(spark):
    import os

    there = lambda t: os.path.exists(t.inputFiles()[0].removeprefix("file://"))
    with scratch() as keep:
        a, b = settled(spark.range(3)), settled(spark.range(4))
        with scratch() as inner:
            c, d = settled(spark.range(5)), settled(spark.range(6))
            inner(c)
        keep(b)
        assert [there(t) for t in (a, b, c, d)] == [True, True, True, False]
    assert [there(t) for t in (a, b, c)] == [False, True, False]
    assert there(settled(spark.range(2)))


def test_report(spark, tmp_path):
    lengths = spark.createDataFrame([(50,), (30,), (20,)], "len long")
    text.write_report(lengths, str(tmp_path / "r"), (50, 90))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["# Total size:100\t Total scaffolds: 3", "# Nx\tLength\tL", "N50\t50\t1", "N90\t20\t3"]


def test_earlier_segments_win(spark):
    seg = spark.createDataFrame([("c", "A", 1, 10), ("c", "B", 5, 20), ("c", "C", 6, 8), ("c", "D", 30, 40)], "contig string, seg string, start long, end long")
    c = spark.createDataFrame([("c", p, "c", 35) for p in (1, 7, 10, 11, 20, 25, 30)], "chr1 string, pos1 long, chr2 string, pos2 long")
    got = sorted((r.chr1, r.pos1, r.chr2, r.pos2) for r in contacts.split_by_segments(c, seg).collect())
    assert got == [(s, p, "D", 6) for s, p in (("A", 1), ("A", 7), ("A", 10), ("B", 7), ("B", 16), ("D", 1))]


def test_segments_of_any_length(spark):
    """Segments of a base beside one of ten gigabases, against a plain search; no cell is made for each kilobase."""
    rng = np.random.default_rng(3)
    seg = [("c", "long", 1, 10**10)] + [("d", f"s{k}", int(a), int(a + rng.integers(0, 3000))) for k, a in enumerate(rng.integers(1, 50_000, 40))] + [("d", "rest", 40_000, 10**9)]
    c = [("c", int(p), "d", int(q)) for p, q in zip(rng.integers(1, 2 * 10**10, 200), rng.integers(1, 60_000, 200))]
    order = sorted(seg, key=lambda s: (s[2], s[3], s[1]))
    place = lambda n, p: next(((s[1], p - s[2] + 1) for s in order if s[0] == n and s[2] <= p <= s[3]), None)
    want = sorted((*a, *b) for a, b in ((place(r[0], r[1]), place(r[2], r[3])) for r in c) if a and b)
    got = contacts.split_by_segments(spark.createDataFrame(c, "chr1 string, pos1 long, chr2 string, pos2 long"), spark.createDataFrame(seg, "contig string, seg string, start long, end long"))
    assert rows(got) == want and len(want) > 50


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_quantiles(spark, n):
    x = np.random.default_rng(n).integers(0, 3 * n + 1, n)
    df = spark.createDataFrame([(int(v),) for v in x] + [(None,)], "v long").repartition(3)
    got = {r.share: r.value for r in quantiles(df, "v", [0.0, 0.005, 0.5, 0.9, 1.0]).collect()}
    assert set(got) == ({0.0, 0.005, 0.5, 0.9, 1.0} if n else set())
    assert all(np.isclose(v, np.quantile(x, s)) for s, v in got.items())


def test_whole_division(spark):
    df = spark.createDataFrame([(9_007_199_254_740_993 * 3 + 2,), (0,), (2,), (3,)], "x long")
    assert [r[0] for r in df.select(floor_div(F.col("x"), 3)).collect()] == [9_007_199_254_740_993, 0, 0, 1]


def test_ends_swap_with_all_their_columns(spark):
    c = spark.createDataFrame([("0", "b", 5, "x", "16", "a", 7, "y")], "str1 string, chr1 string, pos1 long, frag1 string, str2 string, chr2 string, pos2 long, frag2 string")
    assert rows(contacts.canonical(c)) == [("16", "a", 7, "y", "0", "b", 5, "x")]


def brute_breaks(s):
    """Break points by plain loops, in exact order of the rules."""
    n = len(s)
    if n <= 100:
        return []
    inner = sorted(s[50 : n - 50])

    def quantile(q):
        at = q * (len(inner) - 1)
        k = int(at)
        return inner[k] + (inner[min(k + 1, len(inner) - 1)] - inner[k]) * (at - k)

    low, high = quantile(0.005), quantile(0.995)
    v = [min(max(x, low), high) if 50 <= k < n - 50 else x for k, x in enumerate(s)]
    m = n - 100
    mirror = lambda i: -1 - i if i < 0 else 2 * m - 1 - i if i >= m else i
    mean = [round(sum(v[50 + mirror(j)] for j in range(i - 5, i + 5)) / 10, 9) for i in range(m)]
    out, last, i = [], None, 1
    while i < m:
        j = i
        while j + 1 < m and mean[j + 1] == mean[i]:
            j += 1
        if mean[i - 1] < mean[i] and j + 1 < m and mean[j + 1] < mean[i] and mean[i] >= 0.7 * max(mean):
            p = (i + j) // 2 + 50
            part = v[p - 40 : p + 1]
            at = p - 40 + part.index(min(part))
            if v[p] - int(min(part)) > 0.6:
                if at != last:
                    out.append((at + p) / 2)
                last = at
        i = j + 1
    return out


def test_break_points_against_plain_loops(spark):
    """Whole signals, and ranges of 64 bins with flat tops that cross their bounds."""
    rng = np.random.default_rng(4)
    signals = {f"s{k}": np.round(np.cumsum(rng.normal(0, 0.3, n)) * 0.2 + np.sin(np.arange(n) / rng.uniform(5, 30)), 2) for k, n in enumerate([90, 100, 101, 150, 220, 400, 700, 1000])}
    signals |= {f"flat{k}": np.repeat(rng.integers(0, 4, 12) * 1.5, rng.integers(5, 90, 12)) for k in range(6)}
    signals["long"] = np.concatenate([np.zeros(150), np.full(200, 2.0), np.zeros(100)])  # a top over three ranges
    df = settled(spark.createDataFrame([(c, b, float(x)) for c, s in signals.items() for b, x in enumerate(s)], "chrom string, bin long, s double").repartition(5))
    want = sorted((c, b) for c, s in signals.items() for b in brute_breaks([float(x) for x in s]))
    assert len(want) > 12
    for span in (correct.SPAN, 64):
        assert rows(correct.break_points(df, span)) == want
    found = correct.break_points(df, 64)
    assert not any(x in found._jdf.queryExecution().toString() for x in ("InPandas", "InArrow", "Python"))
    one = correct.tops(spark.createDataFrame([("t", k, float(x)) for k, x in enumerate([1] * 3 + [2] * 200 + [1] * 70 + [3] * 5)], "chrom string, bin long, mean double"), 16)
    assert rows(one) == [("t", 102, 2.0)]


@pytest.mark.parametrize("span", [16, 4096])
def test_windows_over_ranges(spark, span):
    x = np.random.default_rng(2).random(73)
    df = spark.createDataFrame([("c", b, float(v)) for b, v in enumerate(x)], "chrom string, bin long, s double")
    got = correct.mirrored_mean(df, span=span).orderBy("bin").collect()
    padded = np.pad(x, (5, 4), mode="symmetric")
    assert np.allclose([r["mean"] for r in got], [padded[k : k + 10].mean() for k in range(73)])
    got = correct.windows(df, span).orderBy("bin").collect()
    assert np.allclose([r["mean"] for r in got], [x[max(0, k - 5) : k + 5].mean() for k in range(73)])
    assert [r.low for r in got] == [x[max(0, k - 40) : k + 1].min() for k in range(73)]


def test_break_points(spark):
    x = np.zeros(200)
    x[80:101] = np.linspace(0, 2, 21)
    df = spark.createDataFrame([("short", k, 0.0) for k in range(90)] + [("one", k, float(v)) for k, v in enumerate(x)], "chrom string, bin long, s double")
    found = correct.break_points(df).collect()
    assert len(found) == 1 and found[0].chrom == "one" and 60 <= found[0].break_bin <= 100


def test_assembly_chain(spark):
    lines = spark.createDataFrame([(1, "# note"), (2, ">c1 1 100"), (3, ">c2 2 50"), (4, "1 -2")], "line_no long, value string")
    parts = stats.from_chains(*text.assembly_lines(lines))
    full = layout.with_gaps(layout.place(parts)).orderBy("ord").collect()
    assert [(r.tag, r.start, r.end, r.orient) for r in full] == [("W", 1, 100, "+"), ("U", 101, 200, "proximity_ligation"), ("W", 201, 250, "-")]


def test_chained_layout(spark):
    lines = spark.createDataFrame([(1, ">c1 1 100"), (2, ">c2 2 50"), (3, ">c3 3 400"), (4, "1 -2"), (5, "3")], "line_no long, value string")
    got = stats.layout_of_chains(*text.assembly_lines(lines)).orderBy("chrom", "ord").collect()
    assert [(r.chrom, r.tag, r.start, r.end, r.ord, r.orient) for r in got] == [("scaffold_1", "W", 1, 400, 1, "+"), ("scaffold_2", "W", 1, 100, 1, "+"), ("scaffold_2", "U", 100, 200, 2, "proximity_ligation"), ("scaffold_2", "W", 200, 250, 3, "-")]


def test_review_bundle(spark, tmp_path):
    parts = spark.createDataFrame([("b", 1, "c3", 7, 0), ("a", 1, "c1", 100, 0), ("a", 2, "c2", 50, 1)], "chrom string, ord int, contig string, len long, orient int")
    c = spark.createDataFrame([("c3", 2, "c2", 5), ("c1", 9, "zz", 5)], "chr1 string, pos1 long, chr2 string, pos2 long")
    text.review_bundle(c, parts, str(tmp_path))
    read = lambda x: [r.value for r in spark.read.text(str(tmp_path / x)).collect()]
    assert sorted(read("review.assembly")) == ["1 -2", "3", ">c1 1 100", ">c2 2 50", ">c3 3 7"]
    assert read("sizes") == ["assembly\t157"] and read("contacts") == ["0\tassembly\t151\t0\t16\tassembly\t146\t1"]


def test_sequences_in_pieces(spark, tmp_path):
    parts = spark.createDataFrame([("scaffold_1", 1, "c1", 6, 0), ("scaffold_1", 2, "c2", 2, 1), ("scaffold_2", 1, "c3", 0, 0)], "chrom string, ord int, contig string, len long, orient int")
    seqs = spark.createDataFrame([("c1", "ACGTAC"), ("c2", "GA"), ("c3", "")], "name string, seq string")
    whole = {r.chrom: r.seq for r in stats.joined_sequences(parts, seqs, 3).collect()}
    pieces = stats.placed_pieces(parts, seqs, 3, size=4).orderBy("chrom", "ord", "piece").collect()
    assert {c: "".join(r.seq for r in pieces if r.chrom == c) for c in whole} == whole == {"scaffold_1": "ACGTACNNNTC", "scaffold_2": ""}
    assert max(len(r.seq) for r in pieces) == 4
    text.write_scaffolds(parts, seqs, str(tmp_path / "fa"), 3)
    got = text.read_fasta(spark, str(tmp_path / "fa"))
    assert {r.name: r.seq for r in got.collect()} == whole


def test_connections_by_round(spark):
    schema = "chrom string, ord int, contig string, len long, orient int"
    alone = spark.createDataFrame([(c, 1, c, 10, 0) for c in ("c1", "c2", "c3")], schema)
    one = spark.createDataFrame([("A", 1, "c1", 10, 0), ("A", 2, "c2", 10, 1), ("c3", 1, "c3", 10, 0)], schema)
    two = spark.createDataFrame([("P", 1, "A", 20, 1), ("P", 2, "c3", 10, 0)], schema)
    assert rows(layout.connections(alone, [one, two])) == [(0, "A", "c1", "c2", "ee"), (1, "P", "c1", "c3", "ss"), (1, "P", "c2", "c1", "ee")]


def test_reverse_complement(spark):
    assert spark.sql("select 'ACGTNacgtR' s").select(reverse_complement(F.col("s"))).collect()[0][0] == "YacgtNACGT"


def test_empty_tables(spark):
    contigs = spark.createDataFrame([], "contig string, len long")
    contacts = spark.createDataFrame([], "chr1 string, pos1 long, chr2 string, pos2 long")
    assert density.diagonal(contacts, contigs, 10).count() == 0
    assert stats.nx(contigs).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first > second\nACGT\nAC\n>c2\nGG\n")
    assert [(r.name, r.len, r.seq) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("name").collect()] == [("c1", 6, "ACGTAC"), ("c2", 2, "GG")]
    parts = spark.createDataFrame([("s", 1, "c1", 6, 0), ("s", 2, "c2", 2, 1)], "chrom string, ord int, contig string, len long, orient int")
    agp = layout.with_gaps(layout.place(parts, 10), 10)
    text.write_agp(agp, str(tmp_path / "agp"))
    assert rows(text.read_agp(spark, str(tmp_path / "agp")).select("chrom", "start", "end", "tag")) == rows(agp.select("chrom", "start", "end", "tag"))


def test_stream_of_contacts(spark, tmp_path):
    from hicweave.streaming import contact_stream, diagonal_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("0 a 5 0 16 a 7 1\n0 a 5 0 16 b 7 1\n0 a 12 0 16 a 13 1\n")
    q = diagonal_counts(contact_stream(spark, str(tmp_path / "in")), 10).writeStream.outputMode("complete").format("memory").queryName("density").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("density")) == [("a", 0, 1), ("a", 1, 1)]


def planted(spark, sizes, seed=3, each=10_000, reach=12_000):
    """Contacts and contigs of chromosomes of equal contigs, some of them reversed: contigs in order, by chromosome."""
    rng, size = np.random.default_rng(seed), 40_000
    out, order, k0 = [], [], 0
    for count in sizes:
        pos = rng.integers(0, count * size, count * each)
        other = np.clip(pos + rng.integers(1, reach, len(pos)), 0, count * size - 1)
        flip = rng.integers(0, 2, count)

        def at(p):
            k, o = p // size, p % size
            return [f"c{k0 + x:02d}" for x in k], [int(size - y if flip[x] else y + 1) for x, y in zip(k, o)]

        (c1, p1), (c2, p2) = at(pos), at(other)
        out += list(zip(c1, p1, c2, p2))
        order.append([(f"c{k0 + k:02d}", int(flip[k])) for k in range(count)])
        k0 += count
    contigs = spark.createDataFrame([(f"c{k:02d}", size) for k in range(k0)], "contig string, len long")
    return spark.createDataFrame(out, "chr1 string, pos1 long, chr2 string, pos2 long"), contigs, order


def chromosomes(out):
    found = {}
    for r in sorted(out.collect(), key=lambda r: r.ord):
        found.setdefault(r.chrom, []).append((r.contig, r.orient))
    return sorted(found.values())


def either_way(orders):
    return sorted(min(o, [(c, 1 - x) for c, x in reversed(o)]) for o in orders)


def test_planted_order_is_recovered(spark):
    """Contigs cut from one chromosome come back in order, whichever are reversed."""
    contacts_, contigs, order = planted(spark, [6])
    assert either_way(chromosomes(scaffold(contacts_, contigs, Config(clusters=1, bin_size=2000, triangle=5)))) == either_way(order)


def test_a_run_with_error_correction(spark):
    """Each step of a round by itself, and cuts where the signal of the joined scaffolds has them."""
    contacts_, contigs, order = planted(spark, [7, 4])
    config = Config(clusters=4, bin_size=2000, triangle=5, error_correction=True, near=1000, far=12_000, survey_least=200_000)
    got = chromosomes(scaffold(contacts_, contigs, config))
    average = plans.average_links(contacts_, contigs, config)
    blocks = settled(plans.one_round(contacts_, contigs, average, config, 5, 0))
    placed = layout.place(blocks, config.gap)
    lifted = layout.lift(contacts_, placed).toPandas()
    want = []
    for chrom, part in placed.toPandas().sort_values("ord").groupby("chrom"):
        own = lifted[(lifted.chr1 == chrom) & (lifted.chr2 == chrom)]
        d = (own.pos2 - own.pos1).abs()
        own = own[(d > 1000) & (d < 12_000)]
        n = part.end.max() // 2000 + 1
        down = np.bincount(np.maximum(own.pos1, own.pos2) // 2000, minlength=n)
        up = np.bincount(np.minimum(own.pos1, own.pos2) // 2000, minlength=n)
        found = brute_breaks(np.log10((down + 1) / (up + 1)).tolist()) if part.end.max() > 200_000 else []
        starts = part.start.tolist()
        cuts = sorted({min(range(len(starts)), key=lambda k: (abs(starts[k] - b * 2000), k)) for b in found} - {0})
        parts = list(zip(part.contig, part.orient))
        want += [parts[a:b] for a, b in zip([0, *cuts], [*cuts, len(parts)])]
    assert len(want) >= 2 and sum(map(len, want)) == 11
    assert chromosomes(plans.corrected(contacts_, blocks, config)) == sorted(want)
    assert sorted(c for x in got for c, _ in x) == sorted(c for x in order for c, _ in x)


def test_survey_wants_long_scaffolds_of_other_names(spark):
    """Contacts on a short scaffold, and on a long contig that was joined to nothing, tell nothing."""
    parts = spark.createDataFrame([("long", 1, "a", 600, 0), ("long", 2, "b", 600, 1), ("short", 1, "c", 300, 0), ("short", 2, "d", 300, 0), ("e", 1, "e", 5000, 0)], "chrom string, ord int, contig string, len long, orient int")
    c = spark.createDataFrame([("a", 10, "a", 215), ("a", 500, "b", 590), ("b", 1, "b", 30), ("c", 1, "d", 1), ("e", 1, "e", 150), ("a", 1, "c", 1), ("a", 1, "zz", 1)], "chr1 string, pos1 long, chr2 string, pos2 long")
    inside = correct.surveyed(c, layout.place(parts, 0), 1000)
    assert rows(inside.select("chr1", "pos1", "pos2")) == [("long", 10, 215), ("long", 500, 611), ("long", 1200, 1171)]
    assert rows(correct.directionality(inside, 100, 100, 500)) == [("long", 0, 0, 1), ("long", 2, 1, 0), ("long", 5, 0, 1), ("long", 6, 1, 0)]
    assert rows(correct.same_bin(inside, 1000, 50)) == [("long", 1, 1)] and rows(correct.same_bin(inside, 1000, 20)) == []
    assert correct.surveyed(c, layout.place(parts, 0), 1200).count() == 0  # longer, not as long


@pytest.mark.parametrize("seed", range(3))
def test_breaks_snap_to_the_nearest_part(spark, seed):
    rng = np.random.default_rng(seed)
    starts = {c: np.cumsum(rng.integers(0, 40, n)).tolist() for c, n in (("a", 1), ("b", 7), ("c", 40), ("d", 5))}
    points = [(c, float(rng.integers(0, 120) / 2)) for c in ("a", "b", "c", "zz") for _ in range(25)]
    placed = spark.createDataFrame([(c, k + 1, int(x)) for c, s in starts.items() for k, x in enumerate(s)], "chrom string, ord int, start long")
    want = {(c, min(range(len(starts[c])), key=lambda k: (abs(starts[c][k] - b * 10), k))) for c, b in points if c in starts}
    assert rows(correct.snapped(spark.createDataFrame(points, "chrom string, break_bin double"), placed, 10)) == sorted(want)


def test_pieces_keep_the_names_of_whole_scaffolds(spark):
    schema = "chrom string, ord int, contig string, len long, orient int"
    placed = spark.createDataFrame([(c, k, f"{c}{k}", 5, 0) for c in "xyz" for k in (1, 2, 3)], schema)
    cuts = spark.createDataFrame([("x", 0), ("x", 2), ("y", 0)], "chrom string, cut int")
    got = sorted((r.chrom, r.ord, r.contig) for r in correct.pieces(placed, cuts).collect())
    assert got == [("x_break_1", 1, "x1"), ("x_break_1", 2, "x2"), ("x_break_2", 1, "x3"), *[("y_break_1", k, f"y{k}") for k in (1, 2, 3)], *[("z", k, f"z{k}") for k in (1, 2, 3)]]


def test_contact_map_of_one_contig(spark):
    """Axes from 0, turned ones from the length on, both sides of the diagonal."""
    contigs = spark.createDataFrame([("a", 100_000)], "contig string, len long")
    c = spark.createDataFrame([("a", 1, "a", 25_001), ("a", 7, "a", 200_000)], "chr1 string, pos1 long, chr2 string, pos2 long")
    got = rows(density.contact_map(c.limit(1), contigs, 10_000).select("code", "bx", "by", "n"))
    assert got == [(0, 0, 2, 1), (0, 2, 0, 1), (1, 2, 10, 1), (1, 10, 2, 1), (2, 0, 7, 1), (2, 7, 0, 1), (3, 7, 10, 1), (3, 10, 7, 1)]
    assert (0, 0, 10, 1) in rows(density.contact_map(c, contigs, 10_000).select("code", "bx", "by", "n"))  # clamped to the length


def test_a_stop_by_clusters(spark):
    """A second round leaves fewer scaffolds than asked for: the first one's layout stays, or the second one's, or none."""
    contacts_, contigs, order = stepped(spark)
    few = Config(clusters=2, bin_size=2000, triangle=4)
    assert [len(x) for x in chromosomes(scaffold(contacts_, contigs, few))] == [2, 2, 2]
    assert either_way(chromosomes(scaffold(contacts_, contigs, replace(few, stop="last")))) == either_way(order)
    assert [len(x) for x in chromosomes(scaffold(contacts_, contigs, replace(few, stop="two_before")))] == [1] * 6
    with pytest.raises(RuntimeError):
        scaffold(contacts_, contigs, replace(few, most_rounds=1))
    with pytest.raises(ValueError):
        Config(stop="never")
    # The first round by itself never ends a run by the number of its scaffolds.
    assert len(chromosomes(scaffold(contacts_, contigs, replace(few, clusters=5)))) == 3


def stepped(spark):
    """Six contigs; between the second and the third, and the fourth and the fifth, no contact lies within a triangle of
    four bins, so that a first round joins pairs, and a second one the pairs."""
    contacts_, contigs, order = planted(spark, [6], each=20_000)
    flip = dict(order[0])

    def inward(contig, pos, right):  # bins of a position from the right or the left end of a contig as it lies
        p = 40_000 - pos + 1 if flip[contig] else pos
        return floor_div(40_000 - p + 1 if right else p, 2000)

    for left, right in (("c01", "c02"), ("c03", "c04")):
        near = inward(left, F.col("pos1"), True) + inward(right, F.col("pos2"), False) < 4
        contacts_ = contacts_.filter(~((F.col("chr1") == left) & (F.col("chr2") == right) & near))
    return settled(contacts_), contigs, order


def test_a_run_goes_on_from_whole_rounds(spark, tmp_path, monkeypatch):
    contacts_, contigs, order = stepped(spark)
    config, rounds = Config(clusters=1, bin_size=2000, triangle=4), plans.Rounds(str(tmp_path / "r"))
    whole = rows(scaffold(contacts_, contigs, config))
    one_round = plans.one_round

    def dies(now, lengths, average, config_, triangle, number):
        if number == 1:
            raise KeyboardInterrupt
        return one_round(now, lengths, average, config_, triangle, number)

    monkeypatch.setattr(plans, "one_round", dies)
    with pytest.raises(KeyboardInterrupt):
        scaffold(contacts_, contigs, config, rounds)
    (tmp_path / "r" / "1.blocks").mkdir()  # a round that was cut off
    numbers = []
    monkeypatch.setattr(plans, "one_round", lambda *a: numbers.append(a[-1]) or one_round(*a))
    assert rows(scaffold(contacts_, contigs, config, rounds)) == whole and numbers[0] == 1
    assert rows(scaffold(contacts_, contigs, config, rounds)) == whole and len(numbers) < 20
    first = rows(text.read_agp(spark, str(tmp_path / "r" / "0.agp")).select("chrom", "start", "end", "ord", "tag", "contig", "orient"))
    assert [(r[1], r[2]) for r in first] == [(1, 40_000), (40_101, 80_100)] * 3 and {r[3:5] for r in first} == {(1, "W")}
    with pytest.raises(ValueError):
        scaffold(contacts_, contigs, replace(config, gap=5), rounds)
    rounds.clear(spark)
    assert not (tmp_path / "r").exists()


def test_lines_and_records_over_splits(spark, tmp_path):
    """Names, offsets and numbers carry over file splits: a record over five and more of them, headers at their ends."""
    rng = np.random.default_rng(5)
    records = [(f"r{k}", "".join(rng.choice(list("ACGT"), n))) for k, n in enumerate([0, 3, 700, 1, 60, 0, 0, 2500, 10])]
    body = "".join(f">{n} about > it\n" + "".join(s[a : a + 60] + "\n" for a in range(0, len(s), 60)) for n, s in records)
    folder = tmp_path / "fa"
    folder.mkdir()
    cut = body.index("\n", 1500) + 1
    (folder / "a.fa").write_text(body[:cut])
    (folder / "b.fa").write_text(body[cut:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128b")
    try:
        lines = text.numbered_lines(spark, str(folder)).orderBy("line_no").collect()
        pieces = settled(text.fasta_pieces(spark, str(folder)))
        assert text.split_lines(spark, str(folder)).select("split").distinct().count() > 20
        lengths = rows(text.fasta_lengths(spark, str(folder)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in lines] == list(range(1, body.count("\n") + 1)) and "".join(r.value + "\n" for r in lines) == body
    assert lengths == sorted((n, k + 1, len(s)) for k, (n, s) in enumerate(records))
    got = {}
    for r in pieces.orderBy("record", "offset").collect():
        assert r.offset == len(got.setdefault((r.record, r.name), "")) or not r.piece
        got[r.record, r.name] += r.piece
    assert got == {(k + 1, n): s for k, (n, s) in enumerate(records)}
    parts = spark.createDataFrame([("scaffold_2", 1, "r1", 3, 0), ("scaffold_1", 1, "r7", 2500, 1), ("scaffold_1", 2, "r4", 60, 0), ("scaffold_1", 3, "r2", 700, 1)], "chrom string, ord int, contig string, len long, orient int")
    text.write_scaffold_lines(parts, pieces, str(tmp_path / "out"), 7)
    whole = {r.chrom: r.seq for r in stats.joined_sequences(parts, spark.createDataFrame(records, "name string, seq string"), 7).collect()}
    assert {r.name: r.seq for r in text.read_fasta(spark, str(tmp_path / "out")).collect()} == whole
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect() if r.value[0] == ">"] == [">scaffold_1", ">scaffold_2"]


def test_assembly_files_of_many_splits(spark, tmp_path):
    parts = spark.createDataFrame([(f"s{c:02d}", k, f"c{c}_{k}", 10 + k, k % 2) for c in range(30) for k in range(1, 4)], "chrom string, ord int, contig string, len long, orient int")
    text.write_assembly(parts, str(tmp_path / "a"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        back = stats.from_chains(*text.read_assembly(spark, str(tmp_path / "a")))
        got = sorted((r.chrom, r.ord, r.contig, r.len, r.orient) for r in back.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"chain{int(r.chrom[1:]) + 1}", r.ord, r.contig, r.len, r.orient) for r in parts.collect())


def test_command_line(spark, tmp_path):
    from hicweave.__main__ import arguments, config

    contacts_, contigs, order = planted(spark, [3])
    text.short_lines(contacts_.withColumns({c: F.lit("0") for c in ("str1", "frag1", "str2", "frag2")})).write.text(str(tmp_path / "c"))
    (tmp_path / "f.fa").write_text("".join(f">c{k:02d}\n{'ACGTT' * 8000}\n" for k in range(3)))
    a = arguments(["scaffold", "--contacts", str(tmp_path / "c"), "--fasta", str(tmp_path / "f.fa"), "--out", str(tmp_path / "out"), "--clusters", "1", "--binsize", "2000", "--triangle", "5"])
    assert config(a) == Config(clusters=1, bin_size=2000, triangle=5)
    a.run(spark, a)
    final = text.read_agp(spark, str(tmp_path / "out" / "final.agp")).filter("tag = 'W'").orderBy("ord").collect()
    assert either_way([[(r.contig, int(r.orient == "-")) for r in final]]) == either_way(order)
    fa = text.read_fasta(spark, str(tmp_path / "out" / "final.fa")).collect()
    assert [(r.name, r.len) for r in fa] == [("scaffold_1", 120_200)]
    assert spark.read.text(str(tmp_path / "out" / "contacts")).count() == 30_000
    assert spark.read.text(str(tmp_path / "out" / "rounds" / "0.agp")).count() == 3
    path = lambda x: str(tmp_path / x)

    def command(*argv):
        b = arguments(list(argv))
        b.run(spark, b)
        return b

    command("review", "--agp", path("out/final.agp"), "--contacts", path("c"), "--out", path("review"))
    assert spark.read.text(path("review/contacts")).count() == 30_000
    command("reviewed", "--assembly", path("review/review.assembly"), "--out", path("back.agp"))
    back = text.components_of(text.read_agp(spark, path("back.agp"))).orderBy("ord").collect()
    assert [(r.contig, r.orient) for r in back] == [(r.contig, int(r.orient == "-")) for r in final]
    command("sequences", "--agp", path("out/final.agp"), "--fasta", path("f.fa"), "--out", path("again.fa"))
    assert text.read_fasta(spark, path("again.fa")).collect() == fa
    command("sizes", "--agp", path("out/final.agp"), "--out", path("sizes"))
    assert [r.value for r in spark.read.text(path("sizes")).collect()] == ["scaffold_1\t120200"]
    command("lengths", "--fasta", path("f.fa"), "--out", path("lengths"), "--shares", "50,90")
    assert [r.value for r in spark.read.text(path("lengths")).collect()] == ["# Total size:120000\t Total scaffolds: 3", "# Nx\tLength\tL", "N50\t40000\t2", "N90\t40000\t3"]
