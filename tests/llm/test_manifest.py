"""The dataset manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hicweave.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain_proof(levels, k):
    out = []
    for level in levels[:-1]:
        first = k // 16 * 16
        out.append((level[first:k], level[k + 1 : first + 16]))
        k //= 16
    return out


def plain(rows, tamper):
    """rows: (doc_id, source, lang, n_chars, text) -> the manifest's rows, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, plain_leaf(r), plain_leaf(tamper(r))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = plain_levels([x[1] for x in groups[s]])
    top = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for k, (r, leaf, other) in enumerate(groups[s]):
            proof = plain_proof(trees[s], k) + plain_proof(top, j)
            x = other
            for left, right in proof:
                x = H(*left, x, *right)
            out.append((r[0], s, leaf, trees[s][-1][0], top[-1][0], ";".join("".join(a) + "," + "".join(b) for a, b in proof), x, x == top[-1][0]))
    return sorted(out, key=str)


def got(df, **more):
    out = manifest.manifest(df, **more)
    assert out.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return out


def lower(r):
    return (*r[:4], None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r


def claimed():
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, text).otherwise(F.col("text"))}


def test_odd_rows(spark, odd):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns."""
    df = odd.unionByName(odd.limit(4).withColumns({c: F.lit(None).cast(odd.schema[c].dataType) for c in ("doc_id", "source")}))
    df = df.withColumns({c: F.lit("mine") for c in ("key", "_g", "pos", "h", "leaf", "root", "block", "above")})
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert sorted(map(tuple, got(df, claimed=claimed()).collect()), key=str) == plain(rows, lower)


def test_empty(none):
    assert manifest.manifest(none).count() == 0


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 256, 257, 1], [4200, 3] + [1] * 300])
def test_trees_of_every_height(spark, sizes):
    """Groups of one row, of one full node, of more levels than a block has; more groups than a block has. Order within a
    group is by id, among groups by the bytes of their names."""
    rows = [(9000 - k, f"s{g:03d}é"[: 4 + g % 2], "en", k, f"Text {k} of {g}") for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    out = got(df, claimed=claimed())
    found = out.collect()
    assert sorted(map(tuple, found), key=str) == plain(rows, lower)
    again = out.select("root", manifest.folded(F.col("leaf"), F.col("proof")).alias("r")).filter("r <> root").count()
    assert again == 0  # leaf and proof alone give the root, by other functions


def test_an_unclaimed_manifest_verifies(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("x").alias("lang"), F.lit(1).alias("n_chars"), F.lit("A").alias("text"))
    assert [r.verified for r in got(df).collect()] == [True] * 40


def test_states_resume_with_right_siblings_only():
    nodes = [hashlib.sha256(bytes([k])).hexdigest().encode() for k in range(20)]
    s = manifest.Slots(nodes)
    for k in range(20):
        first = k // 16 * 16
        new = b"f" * 64
        assert s.fold(k, new).decode() == hashlib.sha256(b"".join(nodes[first:k]) + new + b"".join(nodes[k + 1 : first + 16])).hexdigest()
    assert s.parents == [x for x in manifest.grown(nodes, 1)[1]]
