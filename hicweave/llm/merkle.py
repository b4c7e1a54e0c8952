"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

A section is a line of the text; a paragraph, the leaf, is a run of it that ends with a sentence, in long sentences with
the first word end of a certain kind after SOFT characters, or after HARD characters; in texts of up to SHORT characters a
word is a leaf. Where a leaf ends depends on what is near, so that an insertion changes the leaves around it and not all
that follow: sentences and words end in the signs of many scripts; where a script has none of them, leaves of HARD
characters follow each other to the end of the line. Leaves cover the text wholly.
A leaf's hash is that of its characters, a section's that of its leaves' hashes, the root that of the sections' hashes: a
fingerprint, which lists them all, can be verified from its root down. Where roots differ, an edit is located by descent:
sections are aligned from both ends by their hashes, and the leaves of those that differ, and of no others, in turn.

Equal texts have equal fingerprints. Null texts count as empty, texts of any length are hashed whole. Rows with the same
doc_id are ordered by their text's hash, rows without one come last; a range of neighbours is no smaller than the rows of
one doc_id. Empty tables give empty results; columns named like the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SOFT, HARD, SHORT = 100, 240, 160
#: Signs that end sentences; letters and signs with which a leaf may end, before a blank or, in scripts
#: that have none, by themselves.
STOPS = ".!?\u3002\uff01\uff1f\u0964\u0965\u061f\u06d4\u2026\u037e\u1362\u104b"
BEFORE_BLANK = "dnst\u043c\u043d\u0442\u044c\u0439\u03bd\u03c2\u05d4\u05dd\u05ea\u0646\u0629\u0631\u0930\u0928\u0947\u1295\u10d8"
BY_ITSELF = "\uff0c\u3001\uff1b\uff1a\u7684\u4e86\u306e\u306f\u3092\u0e19\u0e23\u104a"
LEAF = rf"[^{STOPS}]{{{SOFT},{HARD - 1}}}?(?:[{BEFORE_BLANK}] |[{BY_ITSELF}])|[^{STOPS}]{{1,{HARD}}}[{STOPS}]*|[{STOPS}]+"
WORD = r"[^ ]+ ?| "
#: Hexadecimal digits of the hashes of leaves, sections and roots.
LEAF_DIGITS, SECTION_DIGITS, ROOT_DIGITS = 16, 16, 32
#: Neighbours are found within ranges of doc_id; at most so many ranges, so that their limits may be broadcast.
MAX_RANGES = 16384
ROWS_PER_RANGE = 2000


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column) -> Column:
    """root|section:leaf,leaf|section:leaf ..."""
    leaf = F.when(F.char_length(text) <= SHORT, WORD).otherwise(LEAF)
    short = lambda c, digits: F.substring(F.md5(c), 1, digits)
    section = lambda line: F.array_join(F.transform(F.regexp_extract_all(line, leaf, F.lit(0)), lambda x: short(x, LEAF_DIGITS)), ",")
    body = F.array_join(F.transform(F.transform(F.split(text, "\n"), section), lambda s: F.concat(short(s, SECTION_DIGITS), F.lit(":"), s)), "|")
    return _let(body, lambda b: F.concat(F.substring(root_of(b), 1, ROOT_DIGITS), F.lit("|"), b))


def root_of(body: Column) -> Column:
    """The root over the sections' hashes, from what a fingerprint lists behind its root."""
    return F.sha2(F.regexp_replace(body, ":[0-9a-f,]*", ""), 256)


def verified(print_: Column) -> Column:
    """Whether a fingerprint is a tree: each section the hash of its leaves, the root that of its sections."""
    body = F.substring(print_, ROOT_DIGITS + 2, 1 << 30)
    parts = F.forall(F.split(body, r"\|"), lambda s: F.substring(F.md5(F.substring(s, SECTION_DIGITS + 2, 1 << 30)), 1, SECTION_DIGITS) == F.substring(s, 1, SECTION_DIGITS))
    return parts & (F.substring(root_of(body), 1, ROOT_DIGITS) == F.substring(print_, 1, ROOT_DIGITS))


def leaf_list(print_: Column) -> Column:
    """The leaf hashes of a fingerprint, in order."""
    return F.array_remove(F.split(F.regexp_replace(print_, rf"^[0-9a-f]{{{ROOT_DIGITS}}}|\|[0-9a-f]{{{SECTION_DIGITS}}}:", ","), ","), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves in common, from two fingerprints alone: 1 for equal roots, 0 where no leaf is shared."""
    sets = F.struct(F.array_distinct(leaf_list(a)).alias("x"), F.array_distinct(leaf_list(b)).alias("y"))
    share = lambda s: _let(F.size(F.array_intersect(s["x"], s["y"])), lambda n: n / (F.size(s["x"]) + F.size(s["y"]) - n))
    shared = _let(sets, lambda s: F.when(F.size(s["x"]) + F.size(s["y"]) == 0, 0.0).otherwise(share(s)))
    return F.when(F.substring(a, 1, ROOT_DIGITS) == F.substring(b, 1, ROOT_DIGITS), 1.0).otherwise(shared)


def _middle(x: Column, y: Column) -> Column:
    """struct(at, n, m): elements n of x and m of y from place at on that remain when equal ends are taken off."""
    same = lambda p, q: F.zip_with(p, q, lambda i, j: i.eqNullSafe(j))  # noqa: E731  the shorter is filled up with nulls
    run = lambda p, q: _let(F.array_position(same(p, q), False).cast("int"), lambda k: F.when(k > 0, k - 1).otherwise(F.size(p)))

    def cut(z: Column) -> Column:
        x, y = z["x"], z["y"]
        behind = F.least(z["back"], F.least(F.size(x), F.size(y)) - z["ahead"])
        return _let(behind, lambda n: F.struct(z["ahead"].alias("at"), (F.size(x) - z["ahead"] - n).alias("n"), (F.size(y) - z["ahead"] - n).alias("m")))

    ends = lambda z: F.struct(z["x"].alias("x"), z["y"].alias("y"), run(z["x"], z["y"]).alias("ahead"), run(F.reverse(z["x"]), F.reverse(z["y"])).alias("back"))
    return _let(_let(F.struct(x.alias("x"), y.alias("y")), ends), cut)


def _sections(print_: Column) -> Column:
    """The sections of a fingerprint, each its hash and its leaves."""
    return F.slice(F.split(print_, r"\|"), 2, 1 << 30)


def edited_sections(a: Column, b: Column) -> Column:
    """struct(at, n, m): the edit that makes b of a replaces n sections of a, from number at on, by m of b: the branches
    in which to look. Sections are told by their hashes."""
    hashes = lambda c: F.transform(_sections(c), lambda s: F.substring(s, 1, SECTION_DIGITS))
    return _middle(hashes(a), hashes(b))


def edited_leaves(a: Column, b: Column) -> Column:
    """The same for leaves: those of the sections that differ are compared, after the leaves of the sections before."""
    leaves = lambda sections: F.array_remove(F.flatten(F.transform(sections, lambda s: F.split(F.substring(s, SECTION_DIGITS + 2, 1 << 30), ","))), "")
    both = F.struct(_sections(a).alias("x"), _sections(b).alias("y"), edited_sections(a, b).alias("e"))

    def descend(z: Column) -> Column:
        e = z["e"]
        inner = _middle(leaves(F.slice(z["x"], e["at"] + 1, e["n"])), leaves(F.slice(z["y"], e["at"] + 1, e["m"])))
        ahead = F.size(leaves(F.slice(z["x"], F.lit(1), e["at"])))
        return _let(inner, lambda i: F.struct((ahead + i["at"]).alias("at"), i["n"].alias("n"), i["m"].alias("m")))

    return _let(both, descend)


def _limits(df: DataFrame, key: str, rows_per_range: int, max_ranges: int) -> list[int]:
    """Values of key, descending, at which ranges begin."""
    rows, low, high = df.agg(F.count(key), F.min(key), F.max(key)).collect()[0]
    n = min(max_ranges, math.ceil(rows / rows_per_range)) if rows else 0
    if n < 2:
        return []
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).collect()[0][0]
    return sorted({c for c in cuts if low < c < high}, reverse=True)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = (), rows_per_range: int = ROWS_PER_RANGE, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Adds next_text, the text of the next row by descending key, and next_ for each column of also; the last row gets
    the first's.

    Rows are dealt once, by ranges of the key, and each range also gets the first row of the following one, so that a
    window within ranges sees every neighbour. There is no window over all rows. Null keys come last.
    """
    cuts = _limits(df, key, rows_per_range, max_ranges)
    n = len(cuts) + 1
    whole = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    # The place of the range: a binary search over its limits, MAX_RANGES at most.
    steps = max(1, n.bit_length())
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded into one constant
    whole = whole.withColumn("_cuts", listed if cuts else F.lit(None).cast("array<bigint>"))
    search = f"""aggregate(sequence(1, {steps}), struct(0 as lo, {n - 1} as hi),
        (a, i) -> case when a.lo >= a.hi then a
                  when `{key}` > get(_cuts, (a.lo + a.hi) div 2) then struct(a.lo as lo, int((a.lo + a.hi) div 2) as hi)
                  else struct(int((a.lo + a.hi) div 2 + 1) as lo, a.hi as hi) end,
        a -> a.lo)"""
    whole = whole.withColumn("_r", F.when(F.col(key).isNull(), n - 1).otherwise(F.expr(search)) if cuts else F.lit(0))
    first = df.agg(F.max(key)).collect()[0][0]
    at_start = F.when(F.col("_r") == 0, F.col(key).eqNullSafe(F.lit(first))).otherwise(F.col(key).eqNullSafe(F.get("_cuts", F.col("_r") - 1)))
    whole = whole.withColumn("_places", F.when(at_start, F.array(F.struct(F.lit(0).alias("g"), F.col("_r").alias("r")), F.struct(F.lit(1).alias("g"), F.pmod(F.col("_r") - 1, F.lit(n)).alias("r")))).otherwise(F.array(F.struct(F.lit(0).alias("g"), F.col("_r").alias("r")))))
    whole = whole.drop("_cuts", "_r").withColumn("_place", F.explode("_places")).drop("_places")
    order = Window.partitionBy("_place.r").orderBy("_place.g", F.col(key).desc_nulls_last(), F.xxhash64("_t"))
    whole = whole.withColumns({"next_text": F.lead("_t").over(order)} | {f"next_{c}": F.lead(c).over(order) for c in also})
    return whole.filter("_place.g = 0").drop("_place", "_t")


def query(spark, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("fingerprint", fingerprint(F.col("text")))
    out = with_next(df, also=("fingerprint",)).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third)))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = likeness(F.col("fingerprint"), F.col("edited_fingerprint")), likeness(F.col("fingerprint"), F.col("next_fingerprint"))
    edit = edited_leaves(F.col("fingerprint"), F.col("edited_fingerprint"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"), edit.alias("edit"))
    return out.select(*out.columns[:-1], *[F.col(f"edit.{f}").cast("long").alias(f"edit_{f}") for f in ("at", "n", "m")])


def middle(of: str) -> str:
    """SQL that adds what _middle gives for the lists x and y of a table: pre, and behind."""
    return f"""SELECT *, least(back, least(len(x), len(y)) - pre) AS behind FROM (SELECT *,
    coalesce(list_min(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i])) - 1, len(x)) AS pre,
    coalesce(list_min(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: (CASE WHEN i <= len(x) THEN x[len(x) + 1 - i] END) IS DISTINCT FROM (CASE WHEN i <= len(y) THEN y[len(y) + 1 - i] END))) - 1, len(x)) AS back FROM {of})"""


def flat(sections: str) -> str:
    """SQL for the leaves of a list of sections."""
    return f"list_filter(flatten(list_transform({sections}, lambda s: string_split(substr(s, {SECTION_DIGITS + 2}), ','))), lambda z: z <> '')"


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt, length(t) // 3 AS k FROM d),
e AS (SELECT doc_id, t, nxt, substr(t, 1, length(t) - k) || substr(nxt, 1, k) AS ed FROM n),
f AS (
  SELECT doc_id, which, substr(sha256(regexp_replace(body, ':[0-9a-f,]*', '', 'g')), 1, {ROOT_DIGITS}) || '|' || body AS fp, x FROM (
    SELECT doc_id, which, x, array_to_string(list_transform(list_transform(string_split(x, chr(10)),
      lambda s: array_to_string(list_transform(CASE WHEN length(x) <= {SHORT} THEN regexp_extract_all(s, '{WORD}') ELSE regexp_extract_all(s, '{LEAF}') END, lambda y: substr(md5(y), 1, {LEAF_DIGITS})), ',')),
      lambda s: substr(md5(s), 1, {SECTION_DIGITS}) || ':' || s), '|') AS body
    FROM (SELECT doc_id, 't' AS which, t AS x FROM e UNION ALL SELECT doc_id, 'e', ed FROM e UNION ALL SELECT doc_id, 'n', nxt FROM e))),
v AS (SELECT *, list_filter(string_split(regexp_replace(fp, '^[0-9a-f]{{{ROOT_DIGITS}}}|\|[0-9a-f]{{{SECTION_DIGITS}}}:', ',', 'g'), ','), lambda x: x <> '') AS al, string_split(fp, '|')[2:] AS sec FROM f),
l AS (SELECT *, list_distinct(al) AS lv FROM v),
j AS (
  SELECT a.doc_id, a.x AS t, b.x AS ed, a.fp AS fa, b.fp AS fb, c.fp AS fc, a.lv AS la, b.lv AS lb, c.lv AS lc, a.sec AS x, b.sec AS y
  FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.which = 'e' JOIN l c ON a.doc_id = c.doc_id AND c.which = 'n' WHERE a.which = 't'),
p AS ({middle("j")}),
r AS (
  SELECT * EXCLUDE (x, y, pre, back, behind), len({flat("x[1:pre]")}) AS ahead, {flat("x[pre + 1:len(x) - behind]")} AS x, {flat("y[pre + 1:len(y) - behind]")} AS y FROM p),
q AS ({middle("r")})
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN substr(fa, 1, {ROOT_DIGITS}) = substr(fb, 1, {ROOT_DIGITS}) THEN 1.0 WHEN len(la) + len(lb) = 0 THEN 0.0
       ELSE CAST(len(list_intersect(la, lb)) AS DOUBLE) / (len(la) + len(lb) - len(list_intersect(la, lb))) END AS near_edited,
  CASE WHEN substr(fa, 1, {ROOT_DIGITS}) = substr(fc, 1, {ROOT_DIGITS}) THEN 1.0 WHEN len(la) + len(lc) = 0 THEN 0.0
       ELSE CAST(len(list_intersect(la, lc)) AS DOUBLE) / (len(la) + len(lc) - len(list_intersect(la, lc))) END AS near_next,
  CAST(ahead + pre AS BIGINT) AS edit_at, CAST(len(x) - pre - behind AS BIGINT) AS edit_n, CAST(len(y) - pre - behind AS BIGINT) AS edit_m
FROM q
"""
