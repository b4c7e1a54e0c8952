"""Registered queries of the scaffolding operators and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import floor_div, reverse_complement
from .operators import contacts as C
from .operators import correct, density, layout, score, stats
from .operators import graph as G
from .operators.tables import numbered, quantiles, shared_folder
from .plans import Config, Misjoins, average_links, broken, linked, one_round, pair_scores, scaffold
from .sources import derived as D
from .sources import text as S

B, T = 10_000, 3
CONFIG = Config(clusters=5, bin_size=B, triangle=T)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the oracles, each over those before it.
VIEWS = {
    "contigs": "SELECT concat('ctg', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS contig, CAST(100000 AS BIGINT) AS len FROM supplier",
    "contacts": """SELECT concat('ctg', lpad(CAST(k1 AS VARCHAR), 6, '0')) AS chr1, CASE WHEN k1 % 3 = 1 THEN 100000 - o1 ELSE o1 + 1 END AS pos1,
        concat('ctg', lpad(CAST(k2 AS VARCHAR), 6, '0')) AS chr2, CASE WHEN k2 % 3 = 1 THEN 100000 - o2 ELSE o2 + 1 END AS pos2
      FROM (SELECT k1, o1, k1 + CAST(floor((o1 + d) / 100000) AS BIGINT) AS k2, (o1 + d) % 100000 AS o2
        FROM (SELECT CAST(l_suppkey AS BIGINT) AS k1, (CAST(l_partkey AS BIGINT) * 7919 + CAST(l_orderkey AS BIGINT) * 104729 + CAST(l_linenumber AS BIGINT) * 15485863 + c * 611953) % 100000 AS o1,
          CASE WHEN q <= 35 THEN q * 200 + l_orderkey % 200 ELSE (q - 35) * (q - 35) * 300 + l_orderkey % 300 END AS d
          FROM (SELECT *, (CAST(l_quantity AS BIGINT) + 7 * c - 1) % 50 + 1 AS q FROM lineitem, (VALUES (0), (1), (2), (3)) v(c))))
      WHERE floor(k1 / 5) = floor(k2 / 5)""",
    "parts": """SELECT concat('chr', CAST(CAST(floor(k / 5) AS BIGINT) AS VARCHAR)) AS chrom, k % 5 + 1 AS ord, contig, len, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS orient
      FROM (SELECT *, CAST(substr(contig, 4) AS BIGINT) AS k FROM contigs)""",
    "placed": """SELECT *, start + len - 1 AS "end" FROM (SELECT *, 1 + coalesce(sum(len + 100) OVER (PARTITION BY chrom ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts)""",
    "canon": """SELECT CASE WHEN chr1 > chr2 THEN chr2 ELSE chr1 END AS chr1, CASE WHEN chr1 > chr2 THEN pos2 ELSE pos1 END AS pos1,
        CASE WHEN chr1 > chr2 THEN chr1 ELSE chr2 END AS chr2, CASE WHEN chr1 > chr2 THEN pos1 ELSE pos2 END AS pos2 FROM contacts""",
    "diagonal": """SELECT g.contig, g.bin, CAST(coalesce(n, 0) AS BIGINT) AS n
      FROM (SELECT contig, unnest(range(CAST(floor(len / 10000) AS BIGINT) + 1)) AS bin FROM contigs) g
      LEFT JOIN (SELECT chr1 AS contig, CAST(floor(pos1 / 10000) AS BIGINT) AS bin, count(*) AS n FROM contacts
        WHERE chr1 = chr2 AND floor(pos1 / 10000) = floor(pos2 / 10000) GROUP BY 1, 2) c ON g.contig = c.contig AND g.bin = c.bin""",
    "average": "SELECT median(n) AS average_links FROM diagonal JOIN contigs USING (contig) WHERE bin < floor(len / 10000)",
    "ends": """SELECT contig, e, bin, count(*) AS n FROM (
        SELECT chr1 AS contig, 0 AS e, CAST(floor(least(pos1, len) / 10000) AS BIGINT) AS bin FROM contacts JOIN contigs ON chr1 = contig WHERE chr1 = chr2
        UNION ALL SELECT chr1, 1, CAST(floor((len - least(pos1, len) + 1) / 10000) AS BIGINT) FROM contacts JOIN contigs ON chr1 = contig WHERE chr1 = chr2)
      WHERE bin < 30 GROUP BY 1, 2, 3""",
    "dense": """SELECT contig, e, bin, n, average_links / (n + 1) AS w, row_number() OVER (PARTITION BY contig, e ORDER BY bin) - 1 AS rank
      FROM ends, average WHERE n >= greatest(0.3 * average_links, 30)""",
    "cells": """SELECT c.chr1 AS x, c.chr2 AS y, ex.e AS ex, ey.e AS ey,
        CASE WHEN ex.e = 0 THEN CAST(floor(c.pos1 / 10000) AS BIGINT) ELSE CAST(floor((a.len - c.pos1 + 1) / 10000) AS BIGINT) END AS bx,
        CASE WHEN ey.e = 0 THEN CAST(floor(c.pos2 / 10000) AS BIGINT) ELSE CAST(floor((b.len - c.pos2 + 1) / 10000) AS BIGINT) END AS by_
      FROM canon c JOIN contigs a ON c.chr1 = a.contig JOIN contigs b ON c.chr2 = b.contig, (VALUES (0), (1)) ex(e), (VALUES (0), (1)) ey(e) WHERE c.chr1 <> c.chr2""",
    "scores": """SELECT x, y, ex + 2 * ey AS code, CAST(round_even(sum(dx.w * dy.w), 0) AS BIGINT) AS score
      FROM cells JOIN dense dx ON dx.contig = x AND dx.e = ex AND dx.bin = bx JOIN dense dy ON dy.contig = y AND dy.e = ey AND dy.bin = by_
      WHERE dx.rank + dy.rank < 3 GROUP BY 1, 2, 3""",
    "best": """SELECT x, y, score, CASE WHEN score > 0 THEN code ELSE 0 END AS code
      FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, code) AS k FROM scores) WHERE k = 1""",
    "norm": """SELECT x AS i, y AS j, code, CASE WHEN score = 0 THEN 0.0 ELSE round_even(score / s * power(2.0, 10 - greatest(floor(log2(score / s)), -14)), 0) / power(2.0, 10 - greatest(floor(log2(score / s)), -14)) END AS v
      FROM (SELECT *, sum(CASE WHEN k <= 5 THEN score END) OVER (PARTITION BY x) AS s, max(score) OVER (PARTITION BY x) AS m
        FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y DESC) AS k
          FROM (SELECT x, y, score, code FROM best UNION ALL SELECT y, x, score, CASE WHEN code IN (1, 2) THEN 3 - code ELSE code END FROM best))) WHERE m > 30""",
    "edges": """SELECT a.i, a.j, (a.v + b.v) / 2 AS w, a.code FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j DESC) AS k FROM norm) WHERE k <= 2) a
      JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j DESC) AS k FROM norm) WHERE k <= 2) b ON a.i = b.j AND a.j = b.i
      WHERE a.i < a.j AND (a.v + b.v) / 2 > 0.3""",
    "lifted": """SELECT p.chrom AS chr1, CASE WHEN p.orient = 1 THEN p."end" - pos1 + 1 ELSE p.start + pos1 - 1 END AS pos1,
        q.chrom AS chr2, CASE WHEN q.orient = 1 THEN q."end" - pos2 + 1 ELSE q.start + pos2 - 1 END AS pos2
      FROM contacts JOIN placed p ON p.contig = chr1 JOIN placed q ON q.contig = chr2""",
    "lparts": """SELECT CASE WHEN r = 32 THEN contig WHEN r < 15 THEN 'lng' || g || 'A' WHEN r < 27 THEN 'lng' || g || 'B' ELSE 'lng' || g || 'C' END AS chrom,
        CAST(1 + CASE WHEN r = 32 THEN 0 WHEN r < 15 THEN r WHEN r < 27 THEN r - 15 ELSE r - 27 END AS INTEGER) AS ord, contig, CAST(CASE WHEN r = 32 THEN 1500000 ELSE 100000 END AS BIGINT) AS len, CASE WHEN k % 3 = 1 AND r < 32 THEN 1 ELSE 0 END AS orient, k
      FROM (SELECT *, CAST(k // 33 AS BIGINT) AS g, k % 33 AS r FROM (SELECT contig, CAST(substr(contig, 4) AS BIGINT) AS k FROM contigs))""",
    "lplaced": """SELECT *, start + len - 1 AS "end" FROM (SELECT *, CAST(1 + coalesce(sum(len + 100) OVER (PARTITION BY chrom ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lparts)""",
    "lcontacts": """WITH q AS (SELECT CAST(l_suppkey AS BIGINT) AS k, CAST(l_partkey AS BIGINT) * 7919 + CAST(l_orderkey AS BIGINT) * 104729 + CAST(l_linenumber AS BIGINT) * 15485863 + c * 611953 AS number, CAST(l_orderkey AS BIGINT) AS x, (CAST(l_quantity AS BIGINT) + 7 * c - 1) % 50 + 1 AS q FROM lineitem, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(c)),
        o AS (SELECT *, k % 33 AS r, number % CASE WHEN k % 33 = 32 THEN 1500000 ELSE 100000 END AS o, CASE WHEN q <= 25 THEN q * 200 + x % 200 ELSE (q - 25) * (q - 25) * 960 + x % 960 END AS d FROM q),
        h AS (SELECT *, CASE WHEN r = 32 THEN 0 WHEN r < 15 THEN r WHEN r < 27 THEN r - 15 ELSE r - 27 END AS p, CASE WHEN r = 32 THEN 1 WHEN r < 15 THEN 15 WHEN r < 27 THEN 12 ELSE 5 END AS many FROM o),
        e AS (SELECT *, p * 100000 + o AS a, p * 100000 + o + d AS b FROM h),
        f AS (SELECT *, CASE WHEN r = 32 THEN k ELSE k - p + b // 100000 END AS k2, CASE WHEN r = 32 THEN b ELSE b % 100000 END AS o2 FROM e WHERE CASE WHEN r = 32 THEN b < 1500000 ELSE b < many * 100000 END)
      SELECT concat('ctg', lpad(CAST(k AS VARCHAR), 6, '0')) AS chr1, CASE WHEN r < 32 AND k % 3 = 1 THEN 100000 - o ELSE o + 1 END AS pos1, concat('ctg', lpad(CAST(k2 AS VARCHAR), 6, '0')) AS chr2, CASE WHEN r < 32 AND k2 % 3 = 1 THEN 100000 - o2 ELSE o2 + 1 END AS pos2
      FROM f WHERE NOT (r < 15 AND k // 33 % 2 = 0 AND a < 700000 AND b >= 700000 AND d > 50000)""",
    "survey": """SELECT p.chrom, CASE WHEN p.orient = 1 THEN p."end" - pos1 + 1 ELSE p.start + pos1 - 1 END AS pos1, CASE WHEN q.orient = 1 THEN q."end" - pos2 + 1 ELSE q.start + pos2 - 1 END AS pos2
      FROM lcontacts JOIN lplaced p ON p.contig = chr1 JOIN lplaced q ON q.contig = chr2 JOIN (SELECT chrom, max("end") AS size FROM lplaced GROUP BY chrom) z ON z.chrom = p.chrom
      WHERE p.chrom = q.chrom AND z.size > 1000000 AND p.chrom <> chr1""",
    "ratio": """SELECT chrom, CAST(b // 10000 AS BIGINT) AS bin, CAST(sum(dn) AS BIGINT) AS down, CAST(sum(up) AS BIGINT) AS up FROM (
        SELECT chrom, greatest(pos1, pos2) AS b, 1 AS dn, 0 AS up FROM survey WHERE abs(pos2 - pos1) > 100000 AND abs(pos2 - pos1) < 500000
        UNION ALL SELECT chrom, least(pos1, pos2), 0, 1 FROM survey WHERE abs(pos2 - pos1) > 100000 AND abs(pos2 - pos1) < 500000) GROUP BY 1, 2""",
    "signal": """SELECT g.chrom, g.bin, count(*) OVER (PARTITION BY g.chrom) AS n, log10((coalesce(down, 0) + 1) / (coalesce(up, 0) + 1)) AS s
      FROM (SELECT chrom, unnest(range(CAST(max("end") // 10000 AS BIGINT) + 1)) AS bin FROM lplaced WHERE chrom IN (SELECT chrom FROM ratio) GROUP BY chrom) g LEFT JOIN ratio r ON r.chrom = g.chrom AND r.bin = g.bin""",
    "clipped": """SELECT chrom, bin, n, CASE WHEN bin BETWEEN 50 AND n - 51 THEN greatest(least(s, high), low) ELSE s END AS v
      FROM (SELECT *, quantile_cont(CASE WHEN bin BETWEEN 50 AND n - 51 THEN s END, 0.005) OVER (PARTITION BY chrom) AS low, quantile_cont(CASE WHEN bin BETWEEN 50 AND n - 51 THEN s END, 0.995) OVER (PARTITION BY chrom) AS high FROM signal) WHERE n > 100""",
    "smooth": """SELECT chrom, i, m, mean FROM (SELECT chrom, i, m, round(avg(v) OVER (PARTITION BY chrom ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 9) AS mean
        FROM (SELECT chrom, n - 100 AS m, v, unnest([bin - 50, CASE WHEN bin - 50 < 5 THEN 49 - bin END, CASE WHEN bin - 50 >= n - 104 THEN 2 * (n - 100) - 1 - (bin - 50) END]) AS i FROM clipped WHERE bin BETWEEN 50 AND n - 51)
        WHERE i IS NOT NULL) WHERE i >= 0 AND i < m""",
    "tops": """SELECT chrom, (a + z) // 2 AS p FROM (
        SELECT *, lag(mean) OVER w AS before, lead(mean) OVER w AS after, max(mean) OVER (PARTITION BY chrom) AS highest FROM (
          SELECT chrom, g, min(i) AS a, max(i) AS z, any_value(mean) AS mean FROM (
            SELECT *, sum(CASE WHEN mean = prior THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY i) AS g FROM (SELECT *, lag(mean) OVER (PARTITION BY chrom ORDER BY i) AS prior FROM smooth)) GROUP BY chrom, g)
        WINDOW w AS (PARTITION BY chrom ORDER BY g)) WHERE mean > before AND mean > after AND mean >= 0.7 * highest""",
    "drops": """SELECT t.chrom, t.p, min(c.v) AS low, arg_min(c.bin, (c.v, c.bin)) AS spot, any_value(CASE WHEN c.bin = t.p + 50 THEN c.v END) AS v
      FROM tops t JOIN clipped c ON c.chrom = t.chrom AND c.bin BETWEEN t.p + 10 AND t.p + 50 GROUP BY t.chrom, t.p""",
    "points": """SELECT chrom, (spot + p + 50) / 2.0 AS break_bin FROM (SELECT *, lag(spot) OVER (PARTITION BY chrom ORDER BY p) AS prior FROM drops WHERE v - trunc(low) > 0.6) WHERE prior IS NULL OR prior <> spot""",
    "cuts": """SELECT DISTINCT chrom, cut FROM (SELECT p.chrom, b.break_bin, arg_min(ord - 1, (abs(start - break_bin * 10000), ord)) AS cut FROM lplaced p JOIN points b ON b.chrom = p.chrom GROUP BY 1, 2)""",
    "lens": "SELECT n_chars AS len FROM documents",
    "seqs": "SELECT concat('seq', CAST(doc_id AS VARCHAR)) AS name, regexp_replace(translate(regexp_replace(text, '\\s', '', 'g'), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM documents",
}


def oracle(select: str) -> str:
    if select.lstrip().startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + f"\n{select}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def average(spark, d) -> float:
    return average_links(D.contacts(spark, d), D.contigs(spark, d), CONFIG)


def dense(spark, d) -> DataFrame:
    fit = C.eligible(D.contigs(spark, d), B, T)
    return G.settled(density.flagged(density.ends(D.contacts(spark, d), fit, B, T), average(spark, d)), "dense")


def scores(spark, d) -> DataFrame:
    return score.triangle(D.contacts(spark, d), C.eligible(D.contigs(spark, d), B, T), dense(spark, d), B, T)


def best(spark, d) -> DataFrame:
    return pair_scores(D.contacts(spark, d), D.contigs(spark, d), average(spark, d), CONFIG, T)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir)


def placed(spark, d) -> DataFrame:
    return layout.place(D.components(spark, d))


def lines(spark, d) -> DataFrame:
    """Contacts as text with uneven white space and a ninth field on some lines."""
    c = D.contacts(spark, d)
    return c.select(F.concat(F.lit(" 0\t"), "chr1", F.lit("  "), F.col("pos1").cast("string"), F.lit(" 0 16\t"), "chr2", F.lit(" "), F.col("pos2").cast("string"), F.lit(" 1"), F.when(F.col("pos1") % 2 == 0, " 60").otherwise("")).alias("value"))


SHORT = "'0' AS str1, chr1, pos1, '0' AS frag1, '16' AS str2, chr2, pos2, '1' AS frag2"


@query("s1_contact_import", f"SELECT {SHORT} FROM contacts")
def _(spark, d):
    return S.contact_lines(lines(spark, d))


@query("s2_contact_scan_strict", f"SELECT {SHORT} FROM contacts WHERE pos1 % 2 = 1")
def _(spark, d):
    tabs = lines(spark, d).select(F.regexp_replace(F.trim("value"), r"\s+", "\t").alias("value"))
    return S.contact_lines(tabs, strict=True)


@query("s3_fasta_scan", "SELECT name, CAST(length(seq) AS BIGINT) AS len FROM seqs")
def _(spark, d):
    records = D.sequences(spark, d).select(F.concat("name", F.lit(" description\n"), F.regexp_replace("seq", "(.{1,60})", "$1\n")).alias("value"))
    return S.fasta_records(records).select("name", "len")


@query("s4_duplicate_names", "SELECT 'b' || CAST(n_chars % 1000 AS VARCHAR) AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return S.duplicate_names(D.read(spark, d, "documents").select(F.concat(F.lit("b"), (F.col("n_chars") % 1000).cast("string")).alias("name")))


KNOWN = "SELECT concat('ctg', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) FROM supplier WHERE s_acctbal >= 0"


@query("p1_known_contigs", f"SELECT * FROM contacts WHERE chr1 IN ({KNOWN}) AND chr2 IN ({KNOWN})")
def _(spark, d):
    return C.known(D.contacts(spark, d), D.known_contigs(spark, d)).select("chr1", "pos1", "chr2", "pos2")


@query("p2_length_eligibility", "SELECT contig, len FROM contigs WHERE len >= 10000 * 3")
def _(spark, d):
    return C.eligible(D.contigs(spark, d), B, T)


@query("p3_canonical_pairs", "SELECT * FROM canon")
def _(spark, d):
    return C.canonical(D.contacts(spark, d))


@query("p4_position_clamp", "SELECT chr1, least(pos1, 90000) AS pos1, chr2, least(pos2, 90000) AS pos2 FROM contacts")
def _(spark, d):
    short = D.contigs(spark, d).withColumn("len", F.lit(90_000).cast("long"))
    return C.with_lengths(D.contacts(spark, d), short).select("chr1", "pos1", "chr2", "pos2")


@query("p5_end_bins", "SELECT x AS contig, ex AS e, bx AS bin, count(*) AS n FROM cells WHERE ey = 0 GROUP BY 1, 2, 3")
def _(spark, d):
    c = C.with_lengths(C.canonical(C.inter(D.contacts(spark, d))), D.contigs(spark, d))
    c = c.select(F.col("chr1").alias("contig"), F.explode(C.end_bins(F.col("pos1"), F.col("len1"), B)).alias("b"))
    return c.groupBy("contig", "b.e", "b.bin").agg(F.count("*").alias("n"))


@query("p7_intra_inter_split", "SELECT chr1 = chr2 AS intra, count(*) AS n FROM contacts GROUP BY 1")
def _(spark, d):
    return D.contacts(spark, d).groupBy((F.col("chr1") == F.col("chr2")).alias("intra")).agg(F.count("*").alias("n"))


@query(
    "p11_segment_split",
    """SELECT chr1 || '_' || CASE WHEN pos1 <= 50000 THEN '1_50000' ELSE '50001_100000' END AS chr1, CASE WHEN pos1 <= 50000 THEN pos1 ELSE pos1 - 50000 END AS pos1,
       chr2 || '_' || CASE WHEN pos2 <= 50000 THEN '1_50000' ELSE '50001_100000' END AS chr2, CASE WHEN pos2 <= 50000 THEN pos2 ELSE pos2 - 50000 END AS pos2
       FROM contacts WHERE pos1 BETWEEN 1 AND 100000 AND pos2 BETWEEN 1 AND 100000""",
)
def _(spark, d):
    at = D.contigs(spark, d).select("contig", F.explode(F.expr("sequence(bigint(1), len, bigint(50000))")).alias("start")).withColumn("end", F.col("start") + 49_999)
    seg = at.withColumn("seg", F.concat_ws("_", "contig", F.col("start").cast("string"), F.col("end").cast("string")))
    return C.split_by_segments(D.contacts(spark, d), seg)


@query(
    "p11_overlapping_segments",
    """SELECT chr1 || '_' || CASE WHEN pos1 <= 60000 THEN '1_60000' ELSE '50001_110000' END AS chr1, CASE WHEN pos1 <= 60000 THEN pos1 ELSE pos1 - 50000 END AS pos1,
       chr2 || '_' || CASE WHEN pos2 <= 60000 THEN '1_60000' ELSE '50001_110000' END AS chr2, CASE WHEN pos2 <= 60000 THEN pos2 ELSE pos2 - 50000 END AS pos2
       FROM contacts WHERE pos1 BETWEEN 1 AND 100000 AND pos2 BETWEEN 1 AND 100000""",
)
def _(spark, d):
    at = D.contigs(spark, d).select("contig", F.explode(F.expr("sequence(bigint(1), len, bigint(50000))")).alias("start")).withColumn("end", F.col("start") + 59_999)
    seg = at.withColumn("seg", F.concat_ws("_", "contig", F.col("start").cast("string"), F.col("end").cast("string")))
    return C.split_by_segments(D.contacts(spark, d), seg)


@query(
    "j8_segments_of_any_length",
    """WITH s AS (SELECT contig, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS seg, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1001 ELSE 1501 END AS a, CASE k WHEN 0 THEN 1000 WHEN 1 THEN 1500 ELSE 1000000000 END AS b FROM contigs, (VALUES (0), (1), (2)) v(k))
       SELECT p.contig || p.seg AS chr1, pos1 - p.a + 1 AS pos1, q.contig || q.seg AS chr2, pos2 - q.a + 1 AS pos2 FROM contacts JOIN s p ON p.contig = chr1 AND pos1 BETWEEN p.a AND p.b JOIN s q ON q.contig = chr2 AND pos2 BETWEEN q.a AND q.b""",
)
def _(spark, d):
    """Half a kilobase, one, and a gigabase on each contig."""
    some = F.array(*[F.struct(F.lit(s).alias("seg"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for s, a, b in (("a", 1, 1000), ("b", 1001, 1500), ("c", 1501, 1_000_000_000))])
    seg = D.contigs(spark, d).select("contig", F.explode(some).alias("s")).select("contig", F.concat("contig", "s.seg").alias("seg"), "s.start", "s.end")
    return C.split_by_segments(D.contacts(spark, d), seg)


@query("j1_contact_lengths", "SELECT chr1, chr2, pos1, pos2, a.len AS len1, b.len AS len2 FROM contacts JOIN contigs a ON chr1 = a.contig JOIN contigs b ON chr2 = b.contig")
def _(spark, d):
    return C.with_lengths(D.contacts(spark, d), D.contigs(spark, d))


@query("a1_diagonal_density", "SELECT * FROM diagonal")
def _(spark, d):
    return density.diagonal(D.contacts(spark, d), D.contigs(spark, d), B)


@query("a2_average_links", "SELECT CAST(average_links AS DOUBLE) AS average_links FROM average")
def _(spark, d):
    c = D.contigs(spark, d)
    return density.average_links(density.diagonal(D.contacts(spark, d), c, B), c, B)


@query("a3_end_density", "SELECT * FROM ends")
def _(spark, d):
    return density.ends(D.contacts(spark, d), D.contigs(spark, d), B, T)


@query("a4_a5_w1_flagged_bins", "SELECT contig, e, bin, n, round(w, 9) AS w, rank FROM dense")
def _(spark, d):
    return dense(spark, d).select("contig", "e", "bin", "n", F.round("w", 9).alias("w"), "rank")


@query("a6_triangle_pair_score", "SELECT * FROM scores")
def _(spark, d):
    return scores(spark, d)


@query("a7_best_score", "SELECT * FROM best")
def _(spark, d):
    return best(spark, d)


@query("a8_row_normalisation", "SELECT i, j, round(v, 9) AS v, code FROM norm")
def _(spark, d):
    return score.normalised(best(spark, d)).select("i", "j", F.round("v", 9).alias("v"), "code")


@query(
    "a9_contact_map",
    """WITH c AS (SELECT chr1, chr2, least(pos1 - 1, a.len) AS p, least(pos2 - 1, b.len) AS q, a.len AS n, b.len AS m FROM canon JOIN contigs a ON a.contig = chr1 JOIN contigs b ON b.contig = chr2),
       t AS (SELECT chr1 AS x, chr2 AS y, e + 2 * f AS code, (CASE WHEN e = 0 THEN p ELSE n - p END) // 10000 AS bx, (CASE WHEN f = 0 THEN q ELSE m - q END) // 10000 AS "by" FROM c, (VALUES (0), (1)) u(e), (VALUES (0), (1)) v(f))
       SELECT x, y, code, CAST(bx AS BIGINT) AS bx, CAST("by" AS BIGINT) AS "by", CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM t UNION ALL SELECT x, y, code, "by", bx FROM t WHERE x = y AND bx <> "by") GROUP BY 1, 2, 3, 4, 5""",
)
def _(spark, d):
    return density.contact_map(D.contacts(spark, d), D.contigs(spark, d), B)


@query("t3_g1_edges", "SELECT i, j, round(w, 9) AS w, code FROM edges")
def _(spark, d):
    return linked(D.contacts(spark, d), D.contigs(spark, d), average(spark, d), CONFIG, T).select("i", "j", F.round("w", 9).alias("w"), "code")


@query(
    "g2_components",
    """WITH RECURSIVE b AS MATERIALIZED (SELECT i AS x, j AS y FROM edges UNION ALL SELECT j, i FROM edges), r AS (SELECT contig, contig AS other FROM contigs UNION SELECT r.contig, y FROM r JOIN b ON x = other)
       SELECT contig, min(other) AS component FROM r GROUP BY contig""",
)
def _(spark, d):
    e = linked(D.contacts(spark, d), D.contigs(spark, d), average(spark, d), CONFIG, T)
    return G.components(G.settled(e, "edges"), D.contigs(spark, d).select("contig"))


@query("g3_g7_paths", "SELECT concat('Block_0_', min(contig) OVER (PARTITION BY chrom)) AS chrom, ord, contig, len, orient FROM parts")
def _(spark, d):
    return one_round(D.contacts(spark, d), D.contigs(spark, d), average(spark, d), CONFIG, T, 0)


@query("w2_cumulative_layout", 'SELECT chrom, ord, contig, len, orient, start, "end" FROM placed')
def _(spark, d):
    return placed(spark, d)


@query(
    "w4_review_layout",
    """SELECT chrom, ord, contig, len, orient, CAST(coalesce(sum(len) OVER w, 1) AS BIGINT) AS start, CAST(coalesce(sum(len) OVER w, 0) + len AS BIGINT) AS "end"
       FROM parts WINDOW w AS (PARTITION BY chrom ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(spark, d):
    return layout.place_joined(D.components(spark, d))


@query("w7_renumbered", """SELECT concat('scaffold_', CAST(dense_rank() OVER (ORDER BY CASE WHEN chrom = '' THEN 1 ELSE 0 END, -z, f) AS VARCHAR)) AS chrom, contig, start FROM (SELECT *, max("end") OVER (PARTITION BY chrom) AS z, min(contig) OVER (PARTITION BY chrom) AS f FROM placed)""")
def _(spark, d):
    return layout.renumbered(placed(spark, d)).select("chrom", "contig", "start")


@query(
    "w8_g10_gap_interleave",
    """SELECT chrom, start, "end", CAST(2 * ord - 1 AS INTEGER) AS ord, 'W' AS tag, contig, '1' AS contig_start, CAST(len AS VARCHAR) AS contig_end, CASE WHEN orient = 1 THEN '-' ELSE '+' END AS orient FROM placed
       UNION ALL SELECT chrom, "end" + 1, "end" + 100, CAST(2 * ord AS INTEGER), 'U', '100', 'scaffold', 'yes', 'proximity_ligation' FROM (SELECT *, max(ord) OVER (PARTITION BY chrom) AS m FROM placed) WHERE ord < m""",
)
def _(spark, d):
    return layout.with_gaps(placed(spark, d))


@query("k1_initial_agp", """SELECT contig AS chrom, 1 AS start, len AS "end", 1 AS ord, 'W' AS tag, contig, 1 AS contig_start, len AS contig_end, 0 AS orient FROM contigs""")
def _(spark, d):
    return layout.initial(D.contigs(spark, d))


@query("k5_a12_chrom_sizes", 'SELECT chrom, max("end") AS size FROM placed GROUP BY 1')
def _(spark, d):
    return layout.sizes(placed(spark, d))


@query("j3_coordinate_lift", "SELECT * FROM lifted")
def _(spark, d):
    return layout.lift(D.contacts(spark, d), placed(spark, d))


@query("k7_lifted_pairs", "SELECT CASE WHEN chr1 > chr2 THEN chr2 ELSE chr1 END AS chr1, CASE WHEN chr1 > chr2 THEN chr1 ELSE chr2 END AS chr2, count(*) AS n FROM lifted GROUP BY 1, 2")
def _(spark, d):
    return C.canonical(layout.lift(D.contacts(spark, d), placed(spark, d))).groupBy("chr1", "chr2").agg(F.count("*").alias("n"))


COMPOSED = """SELECT CASE WHEN n < 2 OR c % 3 = 2 THEN chrom ELSE concat('super', CAST(c // 3 AS VARCHAR)) END AS chrom,
        CAST(CASE WHEN n < 2 OR c % 3 <> 1 THEN ord ELSE first + own + 1 - ord END AS INTEGER) AS ord, contig, len, CASE WHEN n >= 2 AND c % 3 = 1 THEN 1 - orient ELSE orient END AS orient
      FROM (SELECT *, max(CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c // 3) + max(CASE WHEN c % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY c // 3) AS n, count(*) OVER (PARTITION BY c) AS own, count(CASE WHEN c % 3 = 0 THEN 1 END) OVER (PARTITION BY c // 3) AS first
        FROM (SELECT *, CAST(substr(chrom, 4) AS BIGINT) AS c FROM parts))"""


def supers(spark, d) -> tuple[DataFrame, DataFrame]:
    """The planted layout, and one over its scaffolds: of each three, the first and, reversed, the second are joined."""
    child = D.components(spark, d).withColumn("ord", F.col("ord").cast("int"))
    c = child.select("chrom").distinct().withColumn("c", F.substring("chrom", 4, 12).cast("long")).filter("c % 3 < 2")
    both = c.groupBy(floor_div(F.col("c"), 3).alias("g")).agg(F.count("*").alias("n")).filter("n = 2")
    c = c.withColumn("g", floor_div(F.col("c"), 3)).join(both, "g")
    size = child.groupBy("chrom").agg(F.sum("len").alias("len"))
    turned = (F.col("c") % 3).cast("int")
    return child, c.join(size, "chrom").select(F.concat(F.lit("super"), F.col("g").cast("string")).alias("chrom"), (turned + 1).alias("ord"), F.col("chrom").alias("contig"), "len", turned.alias("orient"))


@query("j4_j5_layout_composition", COMPOSED)
def _(spark, d):
    return layout.compose(*supers(spark, d))


@query(
    "g11_connections_by_round",
    f"""SELECT round, a.chrom, a.contig, b.contig AS next, (CASE WHEN a.orient = 1 THEN 's' ELSE 'e' END) || (CASE WHEN b.orient = 1 THEN 'e' ELSE 's' END) AS tag
       FROM (SELECT 0 AS round, chrom, ord, contig, orient FROM parts UNION ALL SELECT 1, chrom, ord, contig, orient FROM ({COMPOSED})) a
       JOIN (SELECT 0 AS round, chrom, ord, contig, orient FROM parts UNION ALL SELECT 1, chrom, ord, contig, orient FROM ({COMPOSED})) b USING (round) WHERE a.chrom = b.chrom AND b.ord = a.ord + 1""",
)
def _(spark, d):
    c = D.contigs(spark, d)
    alone = c.select(F.col("contig").alias("chrom"), F.lit(1).alias("ord"), "contig", "len", F.lit(0).alias("orient"))
    return layout.connections(alone, list(supers(spark, d)))


@query("g11_connections", "SELECT a.chrom, a.contig, b.contig AS next, (CASE WHEN a.orient = 1 THEN 's' ELSE 'e' END) || (CASE WHEN b.orient = 1 THEN 'e' ELSE 's' END) AS tag FROM placed a JOIN placed b ON a.chrom = b.chrom AND b.ord = a.ord + 1")
def _(spark, d):
    return layout.adjacent(placed(spark, d))


def long_placed(spark, d) -> DataFrame:
    return layout.place(D.long_components(spark, d))


def survey(spark, d) -> DataFrame:
    return correct.surveyed(D.long_contacts(spark, d), long_placed(spark, d))


@query("a10_e1_directionality", "SELECT * FROM ratio")
def _(spark, d):
    return correct.directionality(survey(spark, d), B)


def signal(spark, d):
    return correct.signal(correct.directionality(survey(spark, d), B), layout.sizes(long_placed(spark, d)), B)


@query("e2_signal", "SELECT chrom, bin, round(s, 9) AS s FROM signal")
def _(spark, d):
    return signal(spark, d).select("chrom", "bin", F.round("s", 9).alias("s"))


@query("e3_break_points", "SELECT * FROM points")
def _(spark, d):
    return correct.break_points(signal(spark, d))


@query(
    "e1_e5_corrected_layout",
    """WITH m AS (SELECT p.*, c.cut, max(CASE WHEN c.cut IS NOT NULL THEN 1 END) OVER (PARTITION BY p.chrom) AS hit, 1 + coalesce(sum(CASE WHEN c.cut > 0 THEN 1 END) OVER (PARTITION BY p.chrom ORDER BY p.ord), 0) AS piece
         FROM lplaced p LEFT JOIN cuts c ON c.chrom = p.chrom AND c.cut = p.ord - 1)
       SELECT CASE WHEN hit = 1 THEN chrom || '_break_' || CAST(piece AS BIGINT) ELSE chrom END AS chrom, CAST(row_number() OVER (PARTITION BY chrom, piece ORDER BY ord) AS INTEGER) AS ord, contig, len, orient FROM m""",
)
def corrected_layout(spark, d):
    p = long_placed(spark, d)
    return correct.pieces(p, correct.snapped(correct.break_points(signal(spark, d)), p, B))


@query(
    "e4_e5_pieces",
    """SELECT chrom || CASE WHEN ord - 1 < cut OR cut = 0 THEN '_break_1' ELSE '_break_2' END AS chrom, CAST(CASE WHEN ord - 1 < cut OR cut = 0 THEN ord ELSE ord - cut END AS INTEGER) AS ord, contig, len, orient
       FROM placed JOIN (SELECT chrom, arg_min(ord - 1, (abs(start - b * 10000), ord)) AS cut FROM (SELECT *, 3.1 + (CAST(substr(chrom, 4) AS BIGINT) % 7) * 7.3 AS b FROM placed) GROUP BY chrom) USING (chrom)""",
)
def _(spark, d):
    p = placed(spark, d)
    points = p.select("chrom").distinct().select("chrom", (F.lit(3.1) + (F.substring("chrom", 4, 12).cast("long") % 7) * 7.3).alias("break_bin"))
    return correct.pieces(p, correct.snapped(points, p, B))


@query(
    "a13_nx",
    """SELECT nx, len AS length, CAST(k AS BIGINT) AS count FROM (SELECT n.nx, len, k, row_number() OVER (PARTITION BY n.nx ORDER BY k) AS r
       FROM (SELECT len, row_number() OVER (ORDER BY len DESC) AS k, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS c, sum(len) OVER () AS t FROM lens), (VALUES (50), (90), (95), (98), (99)) n(nx) WHERE 100 * c >= n.nx * t) WHERE r = 1""",
)
def _(spark, d):
    return stats.nx(D.read(spark, d, "documents").select(F.col("n_chars").alias("len")))


@query("a14_totals", "SELECT CAST(sum(len) AS BIGINT) AS total, count(*) AS sequences, max(len) AS longest FROM lens")
def _(spark, d):
    return stats.totals(D.read(spark, d, "documents").select(F.col("n_chars").alias("len")))


@query("c1_assembly_chains", "SELECT chrom, string_agg(CAST(CASE WHEN orient = 1 THEN -idx ELSE idx END AS VARCHAR), ' ' ORDER BY ord) AS chain FROM (SELECT *, row_number() OVER (ORDER BY chrom, ord) AS idx FROM parts) GROUP BY chrom")
def _(spark, d):
    return stats.chains(D.components(spark, d))


@query("c2_s7_assembly_layout", """SELECT concat('chain', CAST(dense_rank() OVER (ORDER BY chrom) AS VARCHAR)) AS chrom, CAST(ord AS INTEGER) AS ord, contig, len, orient, start, "end" FROM placed""")
def _(spark, d):
    text = stats.assembly_text(D.components(spark, d))
    return layout.place(stats.from_chains(*S.assembly_lines(text))).select("chrom", "ord", "contig", "len", "orient", "start", "end")


def written(spark, df: DataFrame, name: str, write) -> str:
    """A path in the shared folder that `write` has written df to."""
    path = f"{shared_folder(spark)}/hicweave-{name}-{uuid.uuid4().hex}"
    write(df, path)
    return path


@query("s7_c2_assembly_files", """SELECT concat('chain', CAST(dense_rank() OVER (ORDER BY chrom) AS VARCHAR)) AS chrom, CAST(ord AS INTEGER) AS ord, contig, len, orient FROM parts""")
def _(spark, d):
    """An .assembly text written to files and read back: lines are numbered over files and splits."""
    path = written(spark, D.components(spark, d), "assembly", S.write_assembly)
    return stats.from_chains(*S.read_assembly(spark, path))


@query("s3_s4_fasta_pieces", "SELECT name, CAST(length(seq) AS BIGINT) AS len, CAST(coalesce(nullif(strpos(seq, 'N'), 0) - 1, -1) AS BIGINT) AS first_n FROM seqs")
def _(spark, d):
    """Sequences written as lines of 60 to files and read in pieces: lengths, and where the first N lies."""
    lines = D.sequences(spark, d).select(F.concat(F.lit(">"), "name", F.lit(" text\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")).alias("value"))
    pieces = S.fasta_pieces(spark, written(spark, lines, "fasta", lambda df, path: df.write.text(path)))
    at = F.when(F.instr("piece", "N") > 0, F.col("offset") + F.instr("piece", "N") - 1)
    return pieces.groupBy("name", "record").agg(F.sum(F.length("piece")).cast("long").alias("len"), F.coalesce(F.min(at), F.lit(-1)).cast("long").alias("first_n")).drop("record")


@query(
    "c2_w5_chained_layout",
    """WITH p AS (SELECT *, coalesce(sum(len + 100) OVER (PARTITION BY chrom ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, max(ord) OVER (PARTITION BY chrom) AS m FROM parts),
       n AS (SELECT chrom, concat('scaffold_', CAST(row_number() OVER (ORDER BY max(done + len) DESC, chrom) AS VARCHAR)) AS name FROM p GROUP BY chrom)
       SELECT name AS chrom, CAST(greatest(done, 1) AS BIGINT) AS start, CAST(done + len AS BIGINT) AS "end", CAST(2 * ord - 1 AS INTEGER) AS ord, 'W' AS tag, contig, '1' AS contig_start, CAST(len AS VARCHAR) AS contig_end, CASE WHEN orient = 1 THEN '-' ELSE '+' END AS orient FROM p JOIN n USING (chrom)
       UNION ALL SELECT name, CAST(done + len AS BIGINT), CAST(done + len + 100 AS BIGINT), CAST(2 * ord AS INTEGER), 'U', '100', 'scaffold', 'yes', 'proximity_ligation' FROM p JOIN n USING (chrom) WHERE ord < m""",
)
def _(spark, d):
    return stats.layout_of_chains(*S.assembly_lines(stats.assembly_text(D.components(spark, d))))


@query("w4_super_layout", """SELECT 'assembly' AS chrom, row_number() OVER w AS ord, contig, len, orient, CAST(greatest(coalesce(sum(len) OVER b, 0), 1) AS BIGINT) AS start, CAST(coalesce(sum(len) OVER b, 0) + len AS BIGINT) AS "end"
       FROM parts WINDOW w AS (ORDER BY chrom, ord), b AS (ORDER BY chrom, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    return layout.place_super(D.components(spark, d))


@query(
    "k8_assembly_text",
    """WITH i AS (SELECT *, row_number() OVER (ORDER BY chrom, ord) AS idx FROM parts),
       c AS (SELECT chrom, string_agg(CAST(CASE WHEN orient = 1 THEN -idx ELSE idx END AS VARCHAR), ' ' ORDER BY ord) AS chain FROM i GROUP BY chrom)
       SELECT idx AS line_no, concat('>', contig, ' ', idx, ' ', len) AS value FROM i UNION ALL SELECT (SELECT count(*) FROM i) + row_number() OVER (ORDER BY chrom), chain FROM c""",
)
def _(spark, d):
    return stats.assembly_text(D.components(spark, d))


@query(
    "k8_review_contacts",
    """WITH p AS (SELECT contig, orient, greatest(coalesce(sum(len) OVER b, 0), 1) AS start, coalesce(sum(len) OVER b, 0) + len AS "end" FROM parts WINDOW b AS (ORDER BY chrom, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT CAST(CASE WHEN p.orient = 1 THEN p."end" - pos1 + 1 ELSE p.start + pos1 - 1 END AS BIGINT) AS pos1, CAST(CASE WHEN q.orient = 1 THEN q."end" - pos2 + 1 ELSE q.start + pos2 - 1 END AS BIGINT) AS pos2
       FROM contacts JOIN p ON p.contig = chr1 JOIN p q ON q.contig = chr2""",
)
def _(spark, d):
    return layout.lift(D.contacts(spark, d), G.settled(layout.place_super(D.components(spark, d)), "super")).select("pos1", "pos2")


@query(
    "k7_sorted_contacts",
    "SELECT CASE WHEN chr1 > chr2 THEN chr2 ELSE chr1 END AS chr1, CASE WHEN chr1 > chr2 THEN pos2 ELSE pos1 END AS pos1, CASE WHEN chr1 > chr2 THEN chr1 ELSE chr2 END AS chr2, CASE WHEN chr1 > chr2 THEN pos1 ELSE pos2 END AS pos2 FROM lifted",
)
def _(spark, d):
    return C.canonical(layout.lift(D.contacts(spark, d), placed(spark, d))).orderBy("chr1", "chr2", "pos1", "pos2")


@query(
    "k9_report",
    """WITH h AS (SELECT n.nx, len, k, row_number() OVER (PARTITION BY n.nx ORDER BY k) AS r
       FROM (SELECT len, row_number() OVER (ORDER BY len DESC) AS k, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS c, sum(len) OVER () AS t FROM lens), (VALUES (50), (90), (95), (98), (99)) n(nx) WHERE 100 * c >= n.nx * t)
       SELECT 0 AS line_no, concat('# Total size:', CAST(sum(len) AS BIGINT), chr(9), ' Total scaffolds: ', count(*)) AS value FROM lens UNION ALL SELECT 1, concat('# Nx', chr(9), 'Length', chr(9), 'L')
       UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY nx) AS INTEGER), concat('N', nx, chr(9), len, chr(9), k) FROM h WHERE r = 1""",
)
def _(spark, d):
    return stats.report_lines(D.read(spark, d, "documents").select(F.col("n_chars").alias("len")))


@query("f10_reverse_complement", "SELECT name, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM seqs")
def _(spark, d):
    return D.sequences(spark, d).select("name", reverse_complement(F.col("seq")).alias("seq"))


@query(
    "j7_f12_joined_sequences",
    """SELECT 'g' || CAST(k AS VARCHAR) AS chrom, string_agg(CASE WHEN o = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, repeat('N', 100) ORDER BY i) AS seq
       FROM (SELECT seq, CAST(floor(CAST(substr(name, 4) AS BIGINT) / 10) AS BIGINT) AS k, CAST(substr(name, 4) AS BIGINT) AS i, CAST(substr(name, 4) AS BIGINT) % 2 AS o FROM seqs) GROUP BY k""",
)
def _(spark, d):
    s = D.sequences(spark, d)
    i = F.substring("name", 4, 20).cast("long")
    parts = s.select(F.concat(F.lit("g"), floor_div(i, 10).cast("string")).alias("chrom"), i.alias("ord"), F.col("name").alias("contig"), (i % 2).alias("orient"))
    return stats.joined_sequences(parts, s)


@query(
    "f13_chunks",
    """SELECT name || '_' || CAST(a AS VARCHAR) || '_' || CAST(least(a + 1000, length(seq)) AS VARCHAR) AS name, substr(seq, a + 1, 1000) AS seq
       FROM (SELECT name, seq, unnest(range(0, CAST(length(seq) AS BIGINT), 1000)) AS a FROM seqs) WHERE regexp_matches(substr(seq, a + 1, 1000), '[^N]')""",
)
def _(spark, d):
    return stats.chunks(D.sequences(spark, d), 1000)


@query(
    "g9_scaffolding_run",
    """SELECT contig, CAST(ord AS INTEGER) AS ord, len, orient, start, "end", count(*) OVER (PARTITION BY chrom) AS parts FROM placed""",
)
def _(spark, d):
    c = D.contigs(spark, d)
    return with_parts(scaffold(D.contacts(spark, d), c, Config(clusters=-(-c.count() // D.PER_CHROMOSOME), bin_size=B, triangle=T)))


@query(
    "g9_two_merging_rounds",
    """SELECT contig, CAST(k % 4 + 1 AS INTEGER) AS ord, len, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS orient, CAST(1 + k % 4 * (len + 100) AS BIGINT) AS start, CAST((k % 4 + 1) * len + k % 4 * 100 AS BIGINT) AS "end", count(*) OVER (PARTITION BY k // 4) AS parts
       FROM (SELECT *, CAST(substr(contig, 4) AS BIGINT) AS k FROM contigs)""",
)
def _(spark, d):
    """Pairs in a first round, pairs of pairs in a second one with a larger triangle; a chromosome is turned to its first contig."""
    c = D.contigs(spark, d)
    out = scaffold(D.stepped_contacts(spark, d), c, Config(clusters=-(-c.count() // D.PER_STEPPED), bin_size=B, triangle=T))
    return with_parts(out)


def with_parts(out: DataFrame) -> DataFrame:
    return out.select("contig", "ord", "len", "orient", "start", "end", F.count("*").over(Window.partitionBy("chrom")).alias("parts"))


@query(
    "g9_corrected_run",
    """WITH m AS (SELECT p.*, 1 + coalesce(sum(CASE WHEN c.cut > 0 THEN 1 END) OVER (PARTITION BY p.chrom ORDER BY p.ord), 0) AS piece FROM lplaced p LEFT JOIN cuts c ON c.chrom = p.chrom AND c.cut = p.ord - 1)
       SELECT contig, CAST(row_number() OVER w AS INTEGER) AS ord, len, CASE WHEN count(*) OVER (PARTITION BY chrom, piece) > 1 THEN orient ELSE 0 END AS orient, CAST(1 + sum(len + 100) OVER w - len - 100 AS BIGINT) AS start, CAST(sum(len + 100) OVER w - 100 AS BIGINT) AS "end", count(*) OVER (PARTITION BY chrom, piece) AS parts
       FROM m WINDOW w AS (PARTITION BY chrom, piece ORDER BY ord)""",
)
def _(spark, d):
    """A round that joins across the planted misjoins and breaks what it joined there; asked for as many scaffolds as that
    leaves, the run ends. A chromosome with a pair under the cutoff is joined by a later round, and has to be broken at the
    same contigs."""
    parts, config = D.long_components(spark, d), Config(bin_size=B, triangle=T, error_correction=True, breaks="contig")
    misjoins = Misjoins(D.long_contacts(spark, d), config)
    clusters = broken(misjoins.points(parts.filter("contig <> chrom")), parts, config).select("chrom").distinct().count()
    return with_parts(scaffold(misjoins.contacts, parts.select("contig", "len"), replace(config, clusters=clusters), misjoins=misjoins))


def agp_rows(spark, d) -> DataFrame:
    return layout.with_gaps(placed(spark, d))


PARTS_SQL = """SELECT chrom, start, "end", CAST(2 * ord - 1 AS INTEGER) AS ord, contig, len, CASE WHEN orient = 1 THEN '-' ELSE '+' END AS orient FROM placed"""


@query("s5_agp_rows", f"SELECT chrom, start, \"end\", ord, contig, CAST(len AS VARCHAR) AS contig_end, orient FROM ({PARTS_SQL})")
def _(spark, d):
    text = agp_rows(spark, d).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in S.AGP_COLUMNS]).alias("value"))
    return S.agp_lines(text).filter("tag = 'W'").select("chrom", "start", "end", "ord", "contig", "contig_end", "orient")


@query("s6_k11_header_layout_sizes", 'SELECT chrom, max("end") AS size FROM placed GROUP BY 1')
def _(spark, d):
    text = agp_rows(spark, d).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in S.AGP_COLUMNS]).alias("value"))
    head = spark.range(1).select(F.lit("\t".join(["Chromosome", "Start", "End", "Order", "Tag", "Contig_ID", "Contig_start", "Contig_end", "Orientation"])).alias("head")).select(F.concat("head", F.substring(F.rand().cast("string"), 1, 0)).alias("value"))
    return layout.sizes(S.agp_lines(head.union(text), header=True))


@query("s8_p8_layout_subset", f"SELECT chrom, contig, len FROM ({PARTS_SQL}) WHERE chrom IN ('chr0', 'chr2')")
def _(spark, d):
    return S.components_of(agp_rows(spark, d), ["chr0", "chr2"]).select("chrom", "contig", "len")


@query("a11_same_bin_counts", "SELECT chrom, CAST(pos1 // 10000 AS BIGINT) AS bin, count(*) AS n FROM survey WHERE abs(pos2 - pos1) <= 100000 AND pos1 // 10000 = pos2 // 10000 GROUP BY 1, 2")
def _(spark, d):
    return correct.same_bin(survey(spark, d), B)


@query("t3_u3_mutual_top_two", "SELECT a.i, a.j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j DESC) AS k FROM norm) a JOIN (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j DESC) AS k FROM norm) b ON a.i = b.j AND a.j = b.i WHERE a.k <= 2 AND b.k <= 2 AND a.i < a.j")
def _(spark, d):
    return score.edges(score.normalised(best(spark, d)), -1.0).select("i", "j")


@query("t5_numeric_suffix_order", "SELECT name, row_number() OVER (ORDER BY CAST(substr(name, 4) AS BIGINT)) AS place FROM seqs")
def _(spark, d):
    return numbered(D.sequences(spark, d).select("name"), [F.substring("name", 4, 20).cast("long")], "place")


@query("f8_quantiles", "SELECT round(quantile_cont(len, 0.005), 9) AS low, round(median(len), 9) AS middle, round(quantile_cont(len, 0.995), 9) AS high FROM lens")
def _(spark, d):
    q = quantiles(D.read(spark, d, "documents"), "n_chars", [0.005, 0.5, 0.995])
    return q.agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 9).alias(name) for s, name in ((0.005, "low"), (0.5, "middle"), (0.995, "high"))])


@query(
    "w9_w11_signal_windows",
    """SELECT chrom, bin, round(avg(s) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 9) AS mean,
       round(min(s) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 40 PRECEDING AND CURRENT ROW), 9) AS low FROM signal""",
)
def _(spark, d):
    return correct.windows(signal(spark, d)).select("chrom", "bin", F.round("mean", 9).alias("mean"), F.round("low", 9).alias("low"))


@query(
    "w9_mirrored_mean",
    """WITH f AS (SELECT chrom, n, s, unnest([bin, CASE WHEN bin < 5 THEN -1 - bin END, CASE WHEN bin >= n - 4 THEN 2 * n - 1 - bin END]) AS bin FROM signal)
       SELECT chrom, bin, mean FROM (SELECT chrom, bin, n, round(avg(s) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 9) AS mean FROM f WHERE bin IS NOT NULL) WHERE bin >= 0 AND bin < n""",
)
def _(spark, d):
    return correct.mirrored_mean(signal(spark, d)).select("chrom", "bin", F.round("mean", 9).alias("mean"))


@query(
    "g4_g5_rings_and_conflicts",
    """WITH c AS (SELECT *, floor(k / 7) AS g, k % 7 AS p, 0.5 + (k * 7919 % 1009) / 4096.0 AS w FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)),
       t AS (SELECT g, count(*) AS n, arg_min(p, w) AS t FROM c GROUP BY g)
       SELECT concat('cus', lpad(CAST(CASE WHEN n < 7 OR (g % 3 = 1 AND p = 3) THEN k WHEN g % 3 = 1 AND p > 3 THEN CAST(g * 7 + 4 AS BIGINT) ELSE CAST(g * 7 AS BIGINT) END AS VARCHAR), 8, '0')) AS path,
         CAST(CASE WHEN n < 7 OR (g % 3 = 1 AND p = 3) THEN 1 WHEN g % 3 = 1 AND p > 3 THEN p - 3 WHEN g % 3 = 0 AND t < 6 THEN CASE WHEN p <= t THEN t - p + 1 ELSE t + 8 - p END ELSE p + 1 END AS INTEGER) AS ord,
         concat('cus', lpad(CAST(k AS VARCHAR), 8, '0')) AS contig, CASE WHEN n = 7 AND g % 3 = 0 AND t < 6 THEN 1 ELSE 0 END AS orient
       FROM c JOIN t USING (g)""",
)
def _(spark, d):
    return G.paths(G.settled(D.links(spark, d), "links"), D.linked_contigs(spark, d))


@query("c3_lift_table", 'SELECT contig, chrom, start, "end", orient, max("end") OVER (PARTITION BY chrom) AS chrom_size FROM placed')
def _(spark, d):
    p = placed(spark, d)
    return p.join(layout.sizes(p), "chrom").select("contig", "chrom", "start", "end", "orient", F.col("size").alias("chrom_size"))
