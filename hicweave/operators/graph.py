"""Paths of contigs through the graph of best neighbours, in which a contig has two neighbours at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transposed
from .tables import running, settled, spent


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 50) -> DataFrame:
    """contig, component: the smallest contig that each reaches. Labels spread to neighbours and then jump to the label
    of their label, so that a path of n contigs takes about log n rounds."""
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b")).union(edges.select("j", "i"))
    label = settled(nodes.select("contig", F.col("contig").alias("component")))
    for _ in range(most_rounds):
        near = both.join(label, both["b"] == label["contig"]).groupBy(F.col("a").alias("contig")).agg(F.min("component").alias("m"))
        step = label.join(near, "contig", "left").select("contig", F.least("component", "m").alias("component"))
        jump = step.select(F.col("contig").alias("component"), F.col("component").alias("c2"))
        new = settled(step.join(jump, "component").select("contig", F.least("component", "c2").alias("component")))
        moved = new.join(label.withColumnRenamed("component", "old"), "contig").filter("component <> old").limit(1).count()
        spent(label)
        label = new
        if not moved:
            return label
    raise RuntimeError("components did not settle")


def ranked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (a, b, code, dist, end) of the chains: how many links lie from a over b to the chain's end, and which contig
    that is; and arcs (a, b, code, low) of the rings with `low`, the weakest link of each.

    List ranking by pointer doubling: an arc points to the next one and knows what lies between; in each round it takes
    over what that one knows, so that a chain of n contigs takes log n rounds and no task sees a chain. What has reached
    an end rests and is not written again. An arc that has passed the very link that comes next has been round a ring.
    All arcs that go on have passed as many links, so that each of that ring has, and knows the same weakest link: they
    rest too, after as many rounds as the ring's own length takes, whatever the number of contigs.
    """
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("code").cast("int").alias("code"), F.struct("w", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).alias("low"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), transposed(F.col("code")).cast("int").alias("code"), "low"))
    # A contig has two neighbours at most: the arc that comes from one goes on to the other.
    near = both.groupBy("a").agg(F.collect_list(F.struct("b", "code", "low")).alias("near")).select("a", "near", F.explode("near").alias("x"))
    near = near.withColumn("next", F.get(F.filter("near", lambda y: y["b"] != F.col("x.b")), F.lit(0))["b"])
    first = near.select(F.col("x.b").alias("a"), F.col("a").alias("b"), transposed(F.col("x.code")).cast("int").alias("code"), F.lit(1).cast("long").alias("dist"), F.col("a").alias("end"), F.when(F.col("next").isNotNull(), F.col("a")).alias("na"), F.col("next").alias("nb"), F.col("x.low").alias("low"))
    now = settled(first, "arcs")
    rest, rings, on = now.filter("nb is null"), [], now.filter("nb is not null")
    span, most = 1, edges.count() + 1
    while on.limit(1).count() and span < most:
        other = rest.unionByName(on).select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("dist").alias("_d"), F.col("end").alias("_e"), F.col("na").alias("_na"), F.col("nb").alias("_nb"), F.col("low").alias("_l"))
        step = on.join(other, ["na", "nb"]).select("a", "b", "code", (F.col("dist") + F.col("_d")).alias("dist"), F.col("_e").alias("end"), F.col("_na").alias("na"), F.col("_nb").alias("nb"), F.least("low", "_l").alias("low"))
        now = settled(step, "arcs")
        rest, on = rest.unionByName(now.filter("nb is null")), now.filter("nb is not null")
        round_ = settled(on.filter("low.i = least(na, nb) and low.j = greatest(na, nb)").select("low.i", "low.j").distinct(), "round")
        if round_.limit(1).count():
            whole = (F.col("low.i") == round_["i"]) & (F.col("low.j") == round_["j"])
            rings.append(on.join(round_, whole, "left_semi"))
            on = settled(on.join(round_, whole, "left_anti"), "arcs")
        span *= 2
    ring = on
    for more in rings:
        ring = ring.unionByName(more)
    return rest.select("a", "b", "code", "dist", "end"), ring.select("a", "b", "code", "low")


def chained(edges: DataFrame) -> DataFrame:
    """chain (its smaller end), ord, contig, before and behind: codes of the links to the contigs before and behind, null
    at the ends. A ring is opened at its weakest link, of equals that of the smallest contigs."""
    edges = edges.select("i", "j", "w", "code")
    arcs, rings = ranked(edges)
    if rings.limit(1).count():
        left = rings.filter("a < b and (a <> low.i or b <> low.j)").select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("low.w").alias("w"), "code")
        arcs = arcs.unionByName(ranked(settled(left, "rings"))[0])
    ends = arcs.groupBy("a").agg(F.min("end").alias("m"), F.count("*").alias("n"))
    chain = ends.select("a", F.when(F.col("n") == 1, F.least("m", "a")).otherwise(F.col("m")).alias("chain"))
    known = arcs.join(chain, "a")
    back = known.filter("end = chain").select("chain", (F.col("dist") + 1).alias("ord"), F.col("a").alias("contig"), transposed(F.col("code")).alias("before"))
    first = chain.filter("a = chain").select("chain", F.lit(1).cast("long").alias("ord"), F.col("a").alias("contig"), F.lit(None).cast("int").alias("before"))
    on = known.filter("end <> chain").select(F.col("a").alias("contig"), F.col("code").alias("behind"))
    return back.unionByName(first).join(on, "contig", "left").select("chain", "ord", "contig", "before", "behind")


def split_at_conflicts(chains: DataFrame) -> DataFrame:
    """Adds part, a number, to chains: a contig that meets both neighbours with one end becomes a part of its own, and the
    next one is not looked at.

    That rule is an automaton of two states, looking and not: a contig without conflict leads to looking from either, one
    with a conflict changes the state. So the state at a contig is told by how many conflicts follow each other before it:
    of a run of them, the first, third, fifth ... are split. Runs and parts come from sums over ranges of all chains.
    """
    clash = F.col("before").isNotNull() & F.col("behind").isNotNull() & (F.shiftright("before", 1).bitwiseXOR(F.col("behind")).bitwiseAND(F.lit(1)) == 0)
    counted = running(chains.withColumn("clash", clash), ["chain", "ord"], {"clashes": F.col("clash").cast("long")})
    runs = counted.filter("clash").withColumn("run", F.col("ord") - F.col("clashes"))
    starts = runs.groupBy("chain", "run").agg(F.min("ord").alias("begin"))
    alone = settled(runs.join(starts, ["chain", "run"]).filter("(ord - begin) % 2 = 0").select("chain", "ord"), "alone")
    marks = alone.select("chain", F.explode(F.array("ord", F.col("ord") + 1)).alias("ord"), F.lit(1).cast("long").alias("mark")).distinct()
    marked = chains.join(marks, ["chain", "ord"], "left").withColumn("mark", F.when(F.col("ord") == 1, F.lit(1).cast("long")).otherwise(F.coalesce("mark", F.lit(0).cast("long"))))
    out = running(marked, ["chain", "ord"], {"parts": F.col("mark")})
    return out.select("chain", "ord", "contig", "before", "behind", (F.col("parts") + F.col("mark")).alias("part"))


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """path (the smallest contig of it), ord, contig, orient (1 for contigs that lie reversed). A path leaves its first
    contig by one end and enters each other by one. Contigs without links are paths of one. Joins, sums and groups alone:
    a chromosome of any number of contigs is no task's by itself."""
    parts = settled(split_at_conflicts(settled(chained(edges), "chains")), "parts")
    named = parts.groupBy("part").agg(F.min("contig").alias("path"), F.min("ord").alias("begin"), F.count("*").alias("n"))
    leaves = 1 - F.col("behind").bitwiseAND(F.lit(1))
    enters = F.shiftright("before", 1).bitwiseAND(F.lit(1))
    orient = F.when(F.col("n") == 1, 0).when(F.col("ord") == F.col("begin"), leaves).otherwise(enters)
    found = parts.join(named, "part").select("path", (F.col("ord") - F.col("begin") + 1).cast("int").alias("ord"), "contig", orient.cast("int").alias("orient"))
    ends = edges.select(F.col("i").alias("contig")).union(edges.select("j")).distinct()
    alone = nodes.join(ends, "contig", "left_anti").select(F.col("contig").alias("path"), F.lit(1).alias("ord"), "contig", F.lit(0).alias("orient"))
    return found.unionByName(alone)
