"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Null texts count as empty. Repeated rows are scanned one by one, empty tables give empty results, other columns are
carried along. Offsets are code points, ends exclusive. Texts of any length and with any number of hits are scanned whole,
in time proportional to both: running sums over hits go by blocks of BLOCK, overlaps are told by binary search among
sorted bounds, and masked texts are put together from pieces that are cut block by block.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the contract: kind and pattern in the order in which kinds are listed, then the least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Candidate strings of the entropy scan, made of these signs.
SIGNS = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character that a window of a class must reach: hexadecimal digits, letters of one case, and more kinds of
#: signs. Windows of digits alone never do. A window of 20 has 4.32 bits at most.
BITS = {"hex": 3.0, "case": 3.6, "rare": 3.3, "mixed": 3.6}
NEVER = 99.0
#: Letters that words of few languages have many of: a window of one case with RARE_LEAST of them counts as "rare".
RARE, RARE_LEAST = "jqwxyJQWXY", 2
#: Elements of an array that are folded one by one; longer arrays are folded block by block.
BLOCK = 256
#: A word, in capitals or as up to five humps of an identifier; longer runs of one case are judged by their bits.
WORD = r"(?:[A-Z]{2,19}|[A-Za-z][a-z]{0,18}(?:[A-Z][a-z]{2,18}){0,4})"
#: Seven consonants without a vowel between, which words do not have.
UNSPOKEN = r"(?:[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ][+/_=-]?){7}"
#: Candidates that match are no secrets: words joined by signs (a short number may follow), identifiers, stand-ins that
#: say so at their beginning, as a part, or at their end.
ALLOWED = [
    rf"^(?!.*{UNSPOKEN})[+/_=-]*(?:{WORD}[+/_=-]+)*+{WORD}?[0-9]{{0,8}}$",
    r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"(?i)^(?:your|my|some|the)?[_-]?(?:example|placeholder|changeme|redacted|dummy|sample|x{4,})[+/_=-]",
    r"(?i)(?:example|examplekey|placeholder|changeme|redacted|x{4,})$",
]


def _blocks(x: str) -> str:
    """SQL for the array x cut into arrays of BLOCK elements."""
    return f"transform(sequence(0, (size({x}) - 1) div {BLOCK}), b -> slice({x}, b * {BLOCK} + 1, {BLOCK}))"


def _running(blocks: str, step: str, element: str, kind: str) -> str:
    """SQL for an array of `element`, over $at and $y, for each $y of the arrays in `blocks`: $at is what `step` has made of
    0 and all elements before. A fold that collects its steps copies them; folds over blocks, then over each block, keep
    that short."""
    one = step.replace("$at", "a.at").replace("$y", "y")
    begins = f"""aggregate({blocks}, named_struct('at', 0, 'got', cast(array() as array<int>)),
        (a, q) -> named_struct('at', aggregate(q, a.at, (at, y) -> {step.replace("$at", "at").replace("$y", "y")}), 'got', concat(a.got, array(a.at))), a -> a.got)"""
    return f"""flatten(zip_with({blocks}, {begins}, (q, begin) -> aggregate(q, named_struct('at', begin, 'got', cast(array() as array<{kind}>)),
        (a, y) -> named_struct('at', {one}, 'got', concat(a.got, array({element.replace("$at", "a.at").replace("$y", "y")}))), a -> a.got)))"""


NO_SPANS = "cast(array() as array<struct<s:int,o:int,e:int>>)"


def _located(df: DataFrame, text: str, name: str, pattern: str, order: int, keep: str) -> DataFrame:
    """Adds the array `name` of struct(s, o, e) for the matches of pattern for which `keep`, SQL over x, holds."""
    m, q = f"_{name}_m", f"_{name}_q"
    df = df.withColumn(m, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    between = F.transform(F.split(text, pattern, -1), F.char_length)  # one more than matches: the last is left out
    df = df.withColumn(q, F.when(F.size(m) > 0, F.zip_with(m, F.slice(between, 1, F.size(m)), lambda x, n: F.struct(x.alias("x"), n.alias("n")))))
    df = df.withColumn(q, F.when(F.size(m) > 0, F.expr(_blocks(q))))
    walk = _running(q, "$at + $y.n + char_length($y.x)", "named_struct('x', $y.x, 's', $at + $y.n)", "struct<x:string,s:int>")
    spans = f"transform(filter({walk}, w -> {keep.replace('$x', 'w.x')}), w -> struct(w.s as s, {order} as o, w.s + char_length(w.x) as e))"
    return df.withColumn(name, F.when(F.size(m) > 0, F.expr(spans)).otherwise(F.expr(NO_SPANS))).drop(m, q)


def _count_below(sorted_: str, value: str, strict: bool) -> str:
    """SQL for how many elements of a sorted array are below a value, or not above it: by halving."""
    return f"""aggregate(sequence(1, 32), named_struct('lo', 0, 'hi', size({sorted_})), (a, i) -> case when a.lo >= a.hi then a
        when get({sorted_}, (a.lo + a.hi) div 2) {"<" if strict else "<="} {value} then named_struct('lo', int((a.lo + a.hi) div 2 + 1), 'hi', a.hi)
        else named_struct('lo', a.lo, 'hi', int((a.lo + a.hi) div 2)) end, a -> a.lo)"""


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans, entropy_spans and found_spans: sorted arrays of struct(s, o, e); o is the place of the kind in
    KINDS. The found spans are the base ones and those of the entropy scan that overlap none of them."""
    out = df.drop("entropy_spans").withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    value = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    out = _located(out, "_t", "_assign", ASSIGN, 0, f"char_length(regexp_extract($x, '{value}', 1)) >= {ASSIGN_LEAST}")
    out = _located(out, "_t", "_access", ACCESS, 1, f"char_length($x) >= {ACCESS_LEAST}")
    # Runs of 32 or more among maximal runs: a greedy match never starts inside a longer run.
    out = _located(out, "_t", "_hex", HEX_LONG, 2, f"char_length($x) >= {HEX_LEAST}")
    out = _located(out, "_t", "_entropy", CANDIDATE, 3, f"not ({_allowed('$x')}) and {excess_bits('$x')} >= 0")
    out = out.withColumn("base_spans", F.sort_array(F.concat("_assign", "_access", "_hex")))
    # Base spans that begin before a span's end, less those that end before its start, overlap it.
    begins, ends = F.sort_array(F.transform("base_spans", lambda y: y["s"])), F.sort_array(F.transform("base_spans", lambda y: y["e"]))
    out = out.withColumns({"_begins": F.when(F.size("_entropy") > 0, begins), "_ends": F.when(F.size("_entropy") > 0, ends)})
    extra = F.expr(f"filter(_entropy, x -> {_count_below('_begins', 'x.e', True)} = {_count_below('_ends', 'x.s', False)})")
    out = out.withColumn("found_spans", F.when(F.size("_entropy") == 0, F.col("base_spans")).otherwise(F.sort_array(F.concat("base_spans", extra))))
    return out.withColumnRenamed("_entropy", "entropy_spans").drop("_t", "_assign", "_access", "_hex", "_begins", "_ends")


#: A maximal run that is long enough; possessive, so that a short run costs one pass.
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "entropy")


def _allowed(x: str) -> str:
    return " or ".join(f"{x} rlike '{p.replace(chr(92), chr(92) * 2)}'" for p in ALLOWED)


#: Counts of signs, PLACES to a number of PLACE_BITS bits each; SLOTS numbers hold all signs.
PLACES, PLACE_BITS = 12, 5
SLOTS = -(-len(SIGNS) // PLACES)


def _constant(values, kind: str) -> str:
    """SQL for an array that is folded into a constant."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def _codes() -> list[int]:
    return [max(0, SIGNS.find(chr(k))) for k in range(128)]


def _classes() -> list[int]:
    """For each sign a one at its class's place: digits, letters to f, other letters, the same as capitals, the rest; and a
    one at the place of rare letters."""
    place = lambda c: 0 if c.isdigit() else 4 if not c.isalpha() else (1 if c in "abcdef" else 2) if c.islower() else (3 if c in "ABCDEF" else 5)
    return [(1 << 8 * place(c)) + ((1 << 48) if c in RARE else 0) for c in SIGNS]


def excess_bits(x: str, window: int = WINDOW, classes: bool = True) -> str:
    """SQL for the most by which the Shannon entropy, in bits per character, of a full window of the string x exceeds
    what its class of signs must reach; without classes, the largest entropy itself.

    The fold holds counts by sign, five bits each in SLOTS numbers, counts by class in one number, and the sum h of
    c * log2(c). A step lets one sign in and, once the window is full, one out: two counts and two terms change,
    whatever the window's width and the number of signs, and nothing is counted anew.
    """
    if window >= 1 << PLACE_BITS:
        raise ValueError("counts would overflow")
    term = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    rise = _constant([b - a for a, b in zip(term, term[1:])], "double")  # from c to c + 1
    whole = lambda c: f"shiftleft(1L, {PLACE_BITS} * ({c} % {PLACES}))"
    slot = lambda c: "case " + " ".join(f"when {c} < {(k + 1) * PLACES} then a.c{k}" for k in range(SLOTS)) + " end"
    count = lambda c: f"cast(shiftright({slot(c)}, {PLACE_BITS} * ({c} % {PLACES})) & {(1 << PLACE_BITS) - 1} as int)"
    moved = lambda k: f"a.c{k} + (case when z.i div {PLACES} = {k} then {whole('z.i')} else 0L end) - (case when z.o div {PLACES} = {k} and z.o >= 0 then {whole('z.o')} else 0L end)"
    mask = lambda *places: sum(255 << 8 * p for p in places)
    least = f"""case when k & {mask(1, 2, 3, 4, 5)}L = 0 then {NEVER} when k & {mask(0, 3, 4, 5)}L = 0 or k & {mask(0, 1, 2, 4)}L = 0 then case when shiftright(k, 48) >= {RARE_LEAST} then {BITS['rare']} else {BITS['case']} end
        when k & {mask(2, 4, 5)}L = 0 then {BITS['hex']} else {BITS['mixed']} end"""
    fields = ", ".join(f"'c{k}', 0L" for k in range(SLOTS))
    updates = ", ".join(f"'c{k}', {moved(k)}" for k in range(SLOTS))
    judged = f"{math.log2(window)} - w.h / {window}" + (" - (" + re.sub(r"\bk\b", "w.k", least) + ")" if classes else "")
    return f"""array_max(transform(array(transform(split({x}, ''), y -> get({_constant(_codes(), 'int')}, ascii(y)))), q -> aggregate(
        transform(q, (i, n) -> named_struct('i', i, 'o', case when n >= {window} then get(q, n - {window}) else -1 end, 'full', n >= {window - 1})),
        named_struct({fields}, 'k', 0L, 'h', 0.0D, 'most', -{NEVER}D),
        (a, z) -> transform(array(named_struct(
                'h', case when z.i = z.o then a.h else a.h + get({rise}, {count('z.i')}) - (case when z.o < 0 then 0.0D else get({rise}, {count('z.o')} - 1) end) end,
                'k', a.k + get({_constant(_classes(), 'bigint')}, z.i) - (case when z.o < 0 then 0L else get({_constant(_classes(), 'bigint')}, z.o) end))),
            w -> named_struct({updates}, 'k', w.k, 'h', w.h, 'most', case when z.full then greatest(a.most, {judged}) else a.most end))[0],
        a -> a.most)))"""


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replaces every found span by the mask; overlapping spans are masked as one. Texts without spans and all other
    columns, whatever their names, stay as they are."""
    own = {c: f"_own_{c}" for c in ("base_spans", "entropy_spans", "found_spans") if c in df.columns}
    out = scan(df.withColumnsRenamed(own), text)
    out = out.withColumn("_f", F.when(F.size("found_spans") > 0, F.expr(_blocks("found_spans"))))
    # Of spans that overlap, the first begins a gap; what is kept lies between the furthest end so far and the next gap.
    gaps = f"filter({_running('_f', 'greatest($at, $y.e)', "named_struct('a', $at, 'b', $y.s)", 'struct<a:int,b:int>')}, g -> g.b >= g.a)"
    out = out.withColumn("_g", F.when(F.size("found_spans") > 0, F.expr(gaps)))
    out = out.withColumn("_h", F.when(F.size("found_spans") > 0, F.expr(_blocks("_g"))))
    cut = f"""flatten(transform(_h, q -> transform(array(substr(`{text}`, q[0].a + 1, element_at(q, -1).b - q[0].a)), t -> transform(q, g -> substr(t, g.a - q[0].a + 1, g.b - g.a)))[0]))"""
    tail = f"substr(`{text}`, aggregate(found_spans, 0, (a, y) -> greatest(a, y.e)) + 1)"
    masked = F.expr(f"concat(array_join({cut}, '{mask}'), '{mask}', {tail})")
    out = out.withColumn(text, F.when(F.size("found_spans") > 0, masked).otherwise(F.col(text)))
    return out.drop("base_spans", "entropy_spans", "found_spans", "_f", "_g", "_h").withColumnsRenamed({b: a for a, b in own.items()}).select([f"`{c}`" for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda o: F.size(F.filter("base_spans", lambda x: x["o"] == o)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("found_spans")).alias("spans"), F.size("entropy_spans").cast("long").alias("n_entropy"),
    )


def _either_case(pattern: str) -> str:
    """The pattern with its case-blind group written out by letters."""
    group = re.search(r"\(\?i:(.*?)\)", pattern)
    return pattern.replace(group[0], "(?:" + re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", group[1]) + ")")


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    assign = _either_case(ASSIGN)
    kinds = [assign, ACCESS, HEX, CANDIDATE]
    matches = " UNION ALL ".join(f"SELECT rid, {k} AS o, regexp_extract_all(t, {quoted(p)}) AS m, string_split_regex(t, {quoted(p)}) AS p FROM d" for k, p in enumerate(kinds))
    word = ALLOWED[0].replace("*+", "*").replace(rf"(?!.*{UNSPOKEN})", "")
    allowed = f"(regexp_matches(x, {quoted(word)}) AND NOT regexp_matches(x, {quoted(UNSPOKEN)})) OR " + " OR ".join(f"regexp_matches(x, {quoted(p)})" for p in ALLOWED[1:])
    names = "CASE o " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({matches}),
u AS (SELECT rid, o, i, m[i] AS x, length(p[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
f AS (SELECT rid, o, x, CAST(sum(n + length(x)) OVER (PARTITION BY rid, o ORDER BY i) - length(x) AS BIGINT) AS s FROM u),
base AS (
  SELECT rid, o, s, s + length(x) AS e FROM f
  WHERE CASE o WHEN 0 THEN length(regexp_extract(x, {quoted(assign)}, 1)) >= {ASSIGN_LEAST} WHEN 1 THEN length(x) >= {ACCESS_LEAST} WHEN 2 THEN length(x) >= {HEX_LEAST} ELSE false END),
win AS (
  SELECT x, substr(x, k, {WINDOW}) AS w FROM (SELECT x, unnest(range(1, length(x) - {WINDOW} + 2)) AS k FROM (SELECT DISTINCT x FROM f WHERE o = 3 AND NOT ({allowed})))),
bits AS (
  SELECT x, w, -sum(c / {WINDOW}.0 * log2(c / {WINDOW}.0)) AS h
  FROM (SELECT x, w, ch, CAST(count(*) AS DOUBLE) AS c FROM (SELECT DISTINCT x, w FROM win), (SELECT unnest(range(1, {WINDOW + 1})) AS j), LATERAL (SELECT substr(w, j, 1) AS ch) GROUP BY x, w, ch) GROUP BY x, w),
secret AS (
  SELECT DISTINCT x FROM bits WHERE h >= CASE WHEN regexp_matches(w, '^[0-9]+$') THEN {NEVER} WHEN regexp_matches(w, '^([a-z]+|[A-Z]+)$') THEN CASE WHEN length(regexp_replace(w, '[^{RARE}]', '', 'g')) >= {RARE_LEAST} THEN {BITS['rare']} ELSE {BITS['case']} END
    WHEN regexp_matches(w, '^[0-9a-fA-F]+$') THEN {BITS['hex']} ELSE {BITS['mixed']} END),
ent AS (SELECT rid, o, s, s + length(x) AS e FROM f JOIN secret USING (x) WHERE o = 3),
every AS (SELECT * FROM base UNION ALL SELECT * FROM ent WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = ent.rid AND base.s < ent.e AND ent.s < base.e)),
b AS (SELECT rid, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, o) AS v FROM base GROUP BY rid),
a AS (SELECT rid, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, o) AS v FROM every GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM ent GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.v, '')) AS base_sha256, coalesce(a.v, '') AS spans, coalesce(n.n, 0) AS n_entropy
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN n USING (rid)
"""


ORACLE = _oracle()
