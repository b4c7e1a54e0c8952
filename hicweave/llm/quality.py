"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base columns are wanted of every document. What rules cost beyond them is spent only on documents that the base and
the rules before have let pass. Costs and rejections are estimated on a random sample of rows that pass the base, and
the rule that newly rejects most for its cost comes next.

Null texts count as empty: no words, so the base rule rejects them. Empty tables give empty results, repeated rows are
judged one by one, texts of any length are read whole, and columns beyond the named ones are carried along; a column of
the caller's that has the name of a result column is replaced by the result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spend, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows, in expectation, of the random sample on which costs and selectivities are estimated, at any size of the input;
#: it sets the order of the rules, never a verdict. A rule is timed over each row COPIES times, the least of TRIES counts.
SAMPLE_ROWS = 1000
COPIES, TRIES = 8, 2


@dataclass(frozen=True)
class Rule:
    """A rule rejects a document where `rejects` is true; it may use the text, the base columns and the words, _w."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    """Seconds that a rule takes for the sample, and the share of it that this rule rejects and none before it."""

    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and the words, _w.

    Repeated 3-word windows are found within the row: their 64-bit hashes are sorted with their positions, neighbours
    of equal hash are kept, and the positions give the words covered. No row is exploded and nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    out = out.withColumn("_w", words(F.col(text)))
    out = out.withColumn(
        "_h",
        F.when(F.size("_w") < 4, F.array().cast("array<bigint>")).otherwise(
            F.expr("transform(sequence(0, greatest(size(_w) - 3, 0)), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)))")
        ),
    )
    bare_lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    out = out.withColumn("_lines", bare_lines)
    out = out.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.expr("array()").cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.expr("sort_array(transform(_h, (h, i) -> struct(h as h, i as i)))")
        ),
    )
    out = out.withColumn(
        "_p",
        F.expr("sort_array(transform(filter(_s, (x, j) -> get(_s, j - 1).h <=> x.h or get(_s, j + 1).h <=> x.h), x -> x.i))"),
    )
    out = out.select(
        *[c for c in out.columns if c not in ("_h", "_lines", "_s", "_p")],
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "aggregate(_p, struct(-3 as last, 0L as n), (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"
        ).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules whose limits lie far from ordinary prose in any language: each looks for one kind of wreckage."""
    t = F.coalesce(F.col(text), F.lit(""))
    per_word = lambda pattern, percent: 100 * F.regexp_count(t, F.lit(pattern)) > percent * F.col("n_words")
    most = """aggregate(sort_array(_w), struct('' as w, 0 as n, 0 as most),
        (a, x) -> case when x = a.w then struct(x as w, a.n + 1 as n, greatest(a.most, a.n + 1) as most) else struct(x as w, 1 as n, greatest(a.most, 1) as most) end,
        a -> a.most)"""
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 25 * F.col("n_words")),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 50 * (F.regexp_count(t, F.lit("\n")) + 1)),
        Rule("long_words", F.col("word_chars") > 20 * F.col("n_words")),
        Rule("short_words", 10 * F.col("word_chars") < 20 * F.col("n_words")),
        Rule("lone_signs", per_word(LONE_SIGNS, 25)),
        Rule("marked_words", per_word(MARKED_WORDS, 30)),
        Rule("one_word", 100 * F.expr(most) > 30 * F.col("n_words")),
        Rule("shouting", per_word("[!?]{2}", 30)),
        Rule("capitals", per_word("[A-Z]{2,}", 60)),
        Rule("no_letters", 100 * F.regexp_count(t, F.lit(r"\p{L}[^\x20\x09-\x0D]*")) < 50 * F.col("n_words")),
    ]


#: A word without letters and digits behind white space; a word that ends in three signs of no sentence.
LONE_SIGNS = r"[\x20\x09-\x0D][^\p{L}\p{N}\x20\x09-\x0D]+(?:[\x20\x09-\x0D]|$)"
MARKED_WORDS = r"[#*$%&|<>~^=_+@]{3}(?:[\x20\x09-\x0D]|$)"


def sampled(df: DataFrame, text: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base columns, the text and the words of about sample_rows random rows, as a small table.

    Each row has the same chance, wherever it lies, and only the rows drawn travel. The rows are drawn before anything
    is counted on them, so that the pass over the table reads its text and no more.
    """
    rows = df.count()
    some = df.select(text) if rows <= sample_rows else df.select(text).sample(sample_rows / rows, 17)
    return materialise(base_columns(some.repartition(4), text), "sample")


def estimate(rows: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """The rules in the order in which they are to run, from a small table with base columns: its rows that pass the base."""
    sample = rows.filter("not base_failed").cache()
    try:
        n = max(1, sample.count())
        copies = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))

        def timed(condition: Column) -> float:
            took = []
            for _ in range(TRIES):
                begin = time.perf_counter()
                copies.agg(F.count_if(condition)).collect()
                took.append(time.perf_counter() - begin)
            return min(took)

        idle = min(timed(F.col("_copy") < k) for k in (0, -1, -2))  # the first ones warm the machine up
        seconds = [max(1e-3, timed(r.rejects) - idle) / COPIES for r in rules]
        bits = F.lit(0).cast("long")
        for k, r in enumerate(rules):
            bits = bits + F.when(r.rejects, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        # One row for each set of rules that rejects a row of the sample.
        found = [(r.bits, r.n) for r in sample.select(bits.alias("bits")).groupBy("bits").agg(F.count("*").alias("n")).collect()]
    finally:
        sample.unpersist()
    return ordered([r.name for r in rules], seconds, found, n)


def ordered(names: list[str], seconds: list[float], found: list[tuple[int, int]], rows: int) -> list[Estimate]:
    """Next comes the rule that rejects most rows for its seconds among those that no rule before it rejects; found:
    sets of rejecting rules, as bits, with their rows. Of rules that reject nothing more, the cheapest comes first."""
    left, out = list(range(len(names))), []
    while left:
        new = {k: sum(n for bits, n in found if bits >> k & 1) for k in left}
        k = min(left, key=lambda k: (-new[k] / seconds[k], seconds[k], names[k]))
        out.append(Estimate(names[k], seconds[k], new[k] / max(1, rows)))
        found = [(bits, n) for bits, n in found if not bits >> k & 1]
        left.remove(k)
    return out


def cascade(df: DataFrame, rules: list[Rule], order: list[Estimate], failed: Column | None = None) -> DataFrame:
    """Adds kept. Rules are nested in the given order, so a rejected document meets no later rule; the verdict is the
    same in any order. Documents for which `failed` holds are rejected before any rule."""
    by_name = {r.name: r.rejects for r in rules}
    kept = F.lit(True)
    for e in reversed(order):
        kept = F.when(F.coalesce(by_name[e.name], F.lit(False)), F.lit(False)).otherwise(kept)
    if failed is not None:
        kept = F.when(failed, F.lit(False)).otherwise(kept)
    return df.withColumn("kept", kept)


def judge(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base columns and the verdict for every row."""
    rules = default_rules(text) if rules is None else rules
    sample = sampled(df, text, sample_rows)
    order = estimate(sample, rules)
    spend(sample)
    return cascade(base_columns(df, text), rules, order, F.col("base_failed")).drop("_w")


def kept_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that are kept, with its columns, whatever their names. The verdicts are a table before they filter:
    as a condition the optimizer would write the counts out again for each rule that uses them."""
    whole = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("text"))
    return materialise(judge(whole).select("_row", "kept"), "judged").filter("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM d),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, i AS p FROM rep UNION ALL SELECT rid, i + 1 FROM rep UNION ALL SELECT rid, i + 2 FROM rep) GROUP BY rid),
b AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
         OR 100 * n_symbols > 25 * n_words
         OR 100 * n_dup_lines > 50 * (length(t) - length(replace(t, chr(10), '')) + 1)
         OR word_chars > 20 * n_words OR 10 * word_chars < 20 * n_words
         OR 100 * len(regexp_extract_all(t, '[\x20\x09-\x0D][^\p{L}\p{N}\x20\x09-\x0D]+(?:[\x20\x09-\x0D]|$)')) > 25 * n_words
         OR 100 * len(regexp_extract_all(t, '[#*$%&|<>~^=_+@]{3}(?:[\x20\x09-\x0D]|$)')) > 30 * n_words
         OR 100 * coalesce(list_max(map_values(list_histogram(w))), 0) > 30 * n_words
         OR 100 * len(regexp_extract_all(t, '[!?]{2}')) > 30 * n_words
         OR 100 * len(regexp_extract_all(t, '[A-Z]{2,}')) > 60 * n_words
         OR 100 * len(regexp_extract_all(t, '\p{L}[^\x20\x09-\x0D]*')) < 50 * n_words) AS kept
FROM b
"""
