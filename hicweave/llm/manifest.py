"""Merkle dataset manifest: one hash for a data set, proofs for its rows, and what root a changed row would give.

A row's fields are hashed to a leaf. The leaves of a group (a source), in order of their keys, are the lowest level of a
tree of FAN children to a node; the roots of the groups, in order of the groups, are the leaves of one more tree, whose
root stands for the data set. A node's hash is that of its children's hashes one after the other, so while a parent is
hashed, the state of the hash before each child is copied and kept. To fold a changed child, the state of its slot goes
on with the new hash and the siblings to its right; what lies to the left is not hashed again.

Trees grow in blocks of BLOCK neighbours, DEPTH levels at a time: a task sees a block, never a group, and a group of any
size takes one pass for each DEPTH levels. Blocks hold whole columns of their leaves and are tables in the shared folder.
States of a hash cannot be written down: on the way down a block gets, for each level above it, the hashes left and right
of its path, sets up the states once, and all its rows go on from them.

Null fields are hashed as "-", so they differ from empty ones. Rows with a null key come first in their group; rows with
one key are ordered by their leaves; repeated rows are rows. The null group comes first. Texts of any length are hashed
whole, by Spark's own function. An empty table has no root and gives no rows. Groups are taken as text; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, trimmed

FAN = 16
#: Levels that a task grows at a time, and the leaves of a block.
DEPTH = 2
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a task gives back at a time; a row's proof has some kilobytes.
ROWS = 2048


def leaf(fields: list[Column]) -> Column:
    """Hash of a row: of each field its length in bytes, a colon and its value, or "-" where it is null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def folded(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give, in DataFrame functions: for who holds no states."""
    step = lambda h, x: F.sha2(F.concat(F.substring_index(x, ",", 1), h, F.substring_index(x, ",", -1)), 256)
    return F.aggregate(F.filter(F.split(proof, ";"), lambda x: x != ""), leaf_, step)


def grown(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The given nodes and so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([hashlib.sha256(b"".join(now[i : i + FAN])).hexdigest().encode() for i in range(0, len(now), FAN)])
    return out


class Slots:
    """The parents over a level of nodes: for each child the hash's state before it, and its siblings on either side."""

    def __init__(self, nodes: list[bytes]) -> None:
        self.state, self.left, self.right, self.parents = [], [], [], []
        for i in range(0, len(nodes), FAN):
            run, now = nodes[i : i + FAN], hashlib.sha256()
            for k, child in enumerate(run):
                self.state.append(now.copy())
                self.left.append(b"".join(run[:k]))
                self.right.append(b"".join(run[k + 1 :]))
                now.update(child)
            self.parents.append(now.hexdigest().encode())

    def fold(self, k: int, child: bytes) -> bytes:
        return _resumed(self.state[k], child, self.right[k])


def _resumed(state, child: bytes, right: bytes) -> bytes:
    now = state.copy()
    now.update(child)
    now.update(right)
    return now.hexdigest().encode()


def slots(nodes: list[bytes], levels: int) -> list[Slots]:
    out = []
    for _ in range(levels):
        out.append(Slots(nodes))
        nodes = out[-1].parents
    return out


def proof_of(levels: list[Slots], k: int, above: bytes) -> bytes:
    """left,right;left,right ... of a block's child k: its siblings in the block, and those of the block."""
    own = []
    for s in levels:
        own.append(s.left[k] + b"," + s.right[k])
        k //= FAN
    return b";".join([*own, above] if above else own)


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row in its group `_g` by the given order, and n, the rows of the group. Rows are dealt by
    ranges, number themselves there, and learn from a table of counts how many of their group lie in ranges before."""

    @trimmed
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("_g").dictionary_encode()
            code, names = g.indices.to_numpy(), g.dictionary.to_pylist()
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            at = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
            if names[code[0]] == last:
                at[: start[1] if len(start) > 1 else len(at)] += done
            last, done = names[code[-1]], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part, np.int32)), pa.array(at)], [*batch.schema.names, "_part", "_at"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    dealt = df.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    dealt = materialise(dealt.mapInArrow(number, f"{schema}, _part int, _at bigint"), "ranks")
    counts = dealt.groupBy("_g", "_part").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("_g")
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_g", "_part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("_begin"), F.sum("m").over(whole).alias("n"))
    return dealt.join(begins, ["_g", "_part"]).select(*df.columns, (F.col("_begin") + F.col("_at")).alias("pos"), "n")


def _packed(nodes: DataFrame) -> DataFrame:
    """Nodes (_g, pos, left, h, and payload columns) as blocks: _g, block, levels grown, left (levels still above), top,
    h and the payload as arrays in order of pos. left of a node is the number of levels above it."""
    payload = [c for c in nodes.columns if c not in ("_g", "pos", "left")]
    kinds = dict(nodes.dtypes)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(t: pa.Table, start: np.ndarray) -> pa.RecordBatch:
            """Rows from start[0] to start[-1]."""
            t = t.slice(0, int(start[-1]))
            offsets = pa.array(start.astype(np.int32))
            first = pa.array(start[:-1])
            left = t.column("left").take(first).to_numpy()
            levels = np.minimum(left, DEPTH)
            h = [x.encode() for x in t.column("h").to_pylist()]
            top = [grown(h[a:b], k)[-1][0].decode() for a, b, k in zip(start[:-1].tolist(), start[1:].tolist(), levels.tolist())]
            lists = [pa.ListArray.from_arrays(offsets, t.column(c).combine_chunks()) for c in payload]
            arrays = [t.column("_g").take(first).combine_chunks(), t.column("block").take(first).combine_chunks(), pa.array(levels.astype(np.int32)), pa.array((left - levels).astype(np.int32)), pa.array(top), *lists]
            return pa.RecordBatch.from_arrays(arrays, ["_g", "block", "levels", "left", "top", *payload])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            g, b = t.column("_g").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("block").to_numpy()
            start = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1])) + 1])
            if len(start) > 1:
                yield blocks(t, start)
            held = t.slice(int(start[-1]))  # the last block may go on
        if held is not None:
            yield blocks(held.combine_chunks(), np.array([0, held.num_rows]))

    dealt = nodes.withColumn("block", F.call_function("div", F.col("pos"), F.lit(BLOCK).cast("long")))
    dealt = dealt.repartition("_g", "block").sortWithinPartitions("_g", "block", "pos").select("_g", "block", "left", *payload)
    lists = ", ".join(f"`{c}` array<{kinds[c]}>" for c in payload)
    return dealt.mapInArrow(run, f"_g string, block bigint, levels int, left int, top string, {lists}")


def _forest(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of each pass, from the leaves to the roots of all groups."""
    out = []
    while True:
        out.append(materialise(_packed(nodes), "blocks"))
        if not (out[-1].agg(F.max("left")).collect()[0][0] or 0):
            return out
        nodes = out[-1].filter("left > 0").select("_g", F.col("block").alias("pos"), "left", F.col("top").alias("h"))


def _children(blocks: DataFrame, named: bool = False) -> DataFrame:
    """What the blocks, with `above` and `subroot`, pass down to each child: _g, block, above, subroot. With named, children
    are groups: _g is the child's own, and subroot its hash."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h = [x.encode() for x in r["h"]]
                up, above = slots(h, r["levels"]), r["above"].encode()
                proofs = [proof_of(up, k, above).decode() for k in range(len(h))]
                if named:
                    yield pa.RecordBatch.from_pydict({"_g": r["key"], "block": [0] * len(h), "above": proofs, "subroot": r["h"]})
                else:
                    yield pa.RecordBatch.from_pydict({"_g": [r["_g"]] * len(h), "block": [r["block"] * BLOCK + k for k in range(len(h))], "above": proofs, "subroot": [r["subroot"]] * len(h)})

    own = ["_g", "block", "levels", "above", "subroot", "h", *(["key"] if named else [])]
    return blocks.select(*own).mapInArrow(run, "_g string, block bigint, above string, subroot string")


def _lowest(passes: list[DataFrame], roots: DataFrame, named: bool = False) -> DataFrame:
    """The first pass's blocks with what lies above them; roots: _g, block, above, subroot of each group's tree."""
    down = None
    for k in range(len(passes) - 1, -1, -1):
        blocks = passes[k]
        ended = blocks.filter("left = 0").join(roots, ["_g", "block"])
        now = ended if down is None else ended.unionByName(blocks.filter("left > 0").join(down, ["_g", "block"]))
        if k:
            down = materialise(_children(now), "above")
    return now


def manifest(df: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, claimed: dict[str, Column] | None = None) -> DataFrame:
    """key, group, leaf, subroot (the group's root), root (the data set's), proof, folded_root and verified of each row.

    proof lists, for each level from the leaf to the root, the siblings left and right of the row's path, as
    left,right;left,right. folded_root is what the row's claimed fields (given as columns over df; the others, and all
    without `claimed`, are as they are) give with these siblings; verified tells whether that is the root.
    """
    now = [F.col(c) for c in fields]
    other = leaf([(claimed or {}).get(c, F.col(c)) for c in fields]) if claimed else F.lit(None).cast("string")
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null is the smallest
    rows = df.select(F.col(key).alias("key"), g.alias("_g"), leaf(now).alias("h"), other.alias("other"))
    rows = materialise(rows.withColumn("other", F.when(F.col("other") != F.col("h"), F.col("other"))), "leaves")
    height = F.when(F.col("n") > 1, F.length(F.hex(F.col("n") - 1))).otherwise(0).cast("int").alias("left")  # digits to base FAN
    trees = _forest(_numbered(rows, ["key", "h"]).select("_g", "pos", height, "h", "key", "other"))
    tops = None
    for t in trees:
        ended = t.filter("left = 0").select("_g", F.col("top").alias("h"))
        tops = ended if tops is None else tops.unionByName(ended)
    groups = _numbered(tops.select(F.lit("").alias("_g"), F.col("_g").alias("key"), "h"), ["key"]).select("_g", "pos", height, "h", "key")
    over = _forest(groups)
    found = over[-1].filter("left = 0").select("top").collect()  # one row
    root = found[0].top if found else ""
    start = over[-1].filter("left = 0").select("_g", "block", F.lit("").alias("above"), F.lit("").alias("subroot"))
    above = materialise(_children(_lowest(over, start), named=True), "above")

    @trimmed
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "_g", "leaf", "subroot", "proof", "folded_root"]
        for batch in batches:
            held, rows_ = [], 0
            for j in range(batch.num_rows):
                r = {c: batch.column(c)[j] for c in batch.schema.names}
                h, other_ = [x.encode() for x in r["h"].as_py()], r["other"].as_py()
                up, outer, known = slots(h, r["levels"].as_py()), r["above"].as_py().encode(), {}
                pairs = [x.split(b",") for x in outer.split(b";")] if outer else []
                states = [(hashlib.sha256(a), b) for a, b in pairs]  # the states before this block's path, for all its rows
                proofs, ends = [], []
                for k, x in enumerate(h):
                    proofs.append(proof_of(up, k, outer))
                    x = other_[k].encode() if other_[k] is not None else x
                    for s in up:
                        x = s.fold(k, x)
                        k //= FAN
                    if x not in known:  # rows whose changes end at the same hash of the block go on together
                        y = x
                        for state, right in states:
                            y = _resumed(state, y, right)
                        known[x] = y.decode()
                    ends.append(known[x])
                n = len(h)
                held.append([r["key"].values, pa.array([r["_g"].as_py()] * n, pa.string()), r["h"].values, pa.array([r["subroot"].as_py()] * n, pa.string()), pa.array([p.decode() for p in proofs], pa.string()), pa.array(ends, pa.string())])
                rows_ += n
                if rows_ >= ROWS or j == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names)
                    held, rows_ = [], 0

    whole = _lowest(trees, above).select("_g", "levels", "above", "subroot", "h", "key", "other")
    out = whole.mapInArrow(audit, f"key {dict(rows.dtypes)['key']}, _g string, leaf string, subroot string, proof string, folded_root string")
    source = F.when(F.col("_g") != "", F.substring("_g", 2, 1 << 30))
    return out.select(F.col("key").alias(key), source.alias(group), "leaf", "subroot", F.lit(root).alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def query(spark, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(*FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))
    out = manifest(df, claimed={"text": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("proof", ",;", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def _oracle(most: int = 6) -> str:
    """Trees of up to `most` levels, level by level, and folding with all siblings."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf_of = lambda t: "sha256(" + " || ".join(field(c) for c in FIELDS[:-1]) + f" || {field(t)})"
    bits = "list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]))))"
    crc = f"xor(list_reduce({bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    step = """{t}{k1} AS (SELECT g, p // 16 AS p, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE max(h) END AS h, (max(n) + 15) // 16 AS n FROM {t}{k} GROUP BY g, p // 16)"""
    side = """{t}s{k} AS (SELECT g, p, CASE WHEN n > 1 THEN array_to_string(hs[1:p % 16], '') END AS l, CASE WHEN n > 1 THEN array_to_string(hs[p % 16 + 2:], '') END AS r
        FROM {t}{k} JOIN (SELECT g, p // 16 AS q, list(h ORDER BY p) AS hs FROM {t}{k} GROUP BY g, p // 16) x USING (g) WHERE x.q = p // 16)"""
    ctes = [
        f"""d AS (SELECT doc_id, source, {leaf_of("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf_of("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf_of("text")} END AS other FROM documents)""",
        """e AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS g FROM d)""",
        """f AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS p, count(*) OVER (PARTITION BY g) AS n FROM e)""",
        "a0 AS (SELECT g, p, leaf AS h, n FROM f)",
    ]
    for k in range(most):
        ctes += [step.format(t="a", k=k, k1=k + 1), side.format(t="a", k=k)]
    ctes.append(f"b0 AS (SELECT '' AS g, CAST(row_number() OVER (ORDER BY g) - 1 AS BIGINT) AS p, h, count(*) OVER () AS n, g AS own FROM a{most} WHERE p = 0)")
    for k in range(most):
        ctes += [step.format(t="b", k=k, k1=k + 1), side.format(t="b", k=k)]
    fold, proof, joins, div = "other", [], [], "f.p"
    for t, key, place in (("a", "f.g", "f.p"), ("b", "''", "b0.p")):
        for k in range(most):
            x = f"{t}s{k}"
            joins.append(f"LEFT JOIN {x} ON {x}.g = {key} AND {x}.p = {place} // {16**k}")
            proof.append(f"coalesce({x}.l || {x}.r, '')")
    ctes.append("w AS (SELECT doc_id, leaf, other, b0.h AS subroot, " + ", ".join(f"{t}s{k}.l AS {t}l{k}, {t}s{k}.r AS {t}r{k}" for t in "ab" for k in range(most)) + f", sha256({' || '.join(proof)}) AS proof_sha256 FROM f JOIN b0 ON b0.own = f.g {' '.join(joins)})")
    last = "w"
    for k, (t, j) in enumerate((t, j) for t in "ab" for j in range(most)):
        ctes.append(f"x{k} AS (SELECT * REPLACE (CASE WHEN {t}l{j} IS NULL THEN other ELSE sha256({t}l{j} || other || {t}r{j}) END AS other) FROM {last})")
        last = f"x{k}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, other AS folded_root, other = root AS verified FROM {last}, (SELECT h AS root FROM b{most} WHERE p = 0)"


ORACLE = _oracle()
