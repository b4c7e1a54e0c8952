"""URL filters: pattern rules indexed by their rarest literal tokens.

A rule is a regular expression with alternatives: sets of literal tokens, of which every match holds one whole set, each
token a whole run of letters and digits. The index holds a rule once for each alternative, under that of its tokens which
the fewest URLs contain; a URL's tokens fetch the rules to try, and only those run. Rules without a literal token are
refused, and so are rules of which the regular expression does not show that every match holds an alternative.

Letters match in either case if they are A to Z; others, even those that some engines fold to them (U+0130, U+0131, U+017F,
U+212A), match as they are: in rules, in the index and in tokens alike.

Null URLs and URLs without :// have empty host and path, fit no base rule and are allowed. Repeated rows and repeated ids
are judged one by one, URLs of any length are judged whole; an empty table or an empty list of rules gives allow.
Columns of the caller's that are named like a result (host, path, rule, verdict, patterns) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Rules are a parameter of the caller; beyond this number the index would not be small, and is refused.
MAX_RULES = 100_000
TOKEN = r"[a-z0-9]+"
#: Ways through a rule's regular expression that are looked at; a rule with more is refused.
MAX_WAYS = 10_000


@dataclass(frozen=True)
class Pattern:
    """tokens: what every match holds; or alternatives, one of which every match holds."""

    name: str
    regex: str
    tokens: tuple[str, ...] = ()
    alternatives: tuple[tuple[str, ...], ...] = ()

    @property
    def entries(self) -> tuple[tuple[str, ...], ...]:
        return self.alternatives or (self.tokens,)


#: Fixed values of the contract: host, path, verdict.
BASE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def either(*words: str) -> tuple[tuple[str, ...], ...]:
    """Alternatives of words, of which the parts between signs are tokens."""
    return tuple(tuple(re.findall(TOKEN, w)) for w in words)


PATTERNS = [
    Pattern("gambling", r"(^|[./-])(casino|casinos)([./-]|$)", alternatives=either("casino", "casinos")),
    Pattern("betting", r"(^|[./-])(free-)?bets?([./-]|$)", alternatives=either("bet", "bets")),
    Pattern("pharmacy", r"(^|[./-])(cheap-)?pills?([./-]|$)", alternatives=either("pill", "pills")),
    Pattern("trackers", r"(^|[./-])ads?-track(er|ing)?([./-]|$)", alternatives=either(*(f"{a}-{t}" for a in ("ad", "ads") for t in ("track", "tracker", "tracking")))),
    Pattern(
        "adult",
        r"(^|[./-])(xxx|adult-x{1,3}|adult-?(video|chat)s?)([./-]|$)",
        alternatives=either("xxx", "adult-x", "adult-xx", *(f"adult{a}{t}" for a in ("", "-") for t in ("video", "videos", "chat", "chats"))),
    ),
    Pattern("farms", r"(^|[./-])(spam|link|content)-farms?([./-]|$)", alternatives=either(*(f"{a}-{t}" for a in ("spam", "link", "content") for t in ("farm", "farms")))),
    Pattern("phishing", r"(^|[./-])(verify|secure|update)-(account|login|wallet)([./-]|$)", alternatives=either(*(f"{a}-{t}" for a in ("verify", "secure", "update") for t in ("account", "login", "wallet")))),
    Pattern("warez", r"(^|[./-])(warez|keygens?|torrents?|crackz)([./-]|$)", alternatives=either("warez", "keygen", "keygens", "torrent", "torrents", "crackz")),
    Pattern("shells", r"/wp-(admin|login)[./]", alternatives=either("wp-admin", "wp-login")),
    Pattern("programs", r"[.](exe|msi|apk|scr)$", alternatives=either("exe", "msi", "apk", "scr")),
    Pattern("calendars", r"/calendar/[0-9]{4}/[0-9]{1,2}/", alternatives=either("calendar")),
    Pattern("carts", r"/(cart|checkout|wishlist)([./-]|$)", alternatives=either("cart", "checkout", "wishlist")),
    Pattern("sign_in", r"/(login|signin|logout|register)([./-]|$)", alternatives=either("login", "signin", "logout", "register")),
    Pattern("tag_pages", r"/tags?/[^/]+/page/[0-9]+", alternatives=either("tag-page", "tags-page")),
]


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    lower = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(lower, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def base_rule(rules=BASE_RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); a rule's text is its host and path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest ends outermost
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.concat("host", F.lit(" "), "path"), UPPER, LOWER), F.lit(TOKEN), F.lit(0)))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)
#: How rules match: letters A to Z in either case, no other letter as one of them.
FLAGS = re.I | re.A
#: What a way through a regular expression passes besides letters and digits: what parts tokens, and what may be anything.
EDGE, ANYTHING = "|", "?"


def _char(code: int) -> str:
    c = chr(code).translate(_TO_LOWER)
    return c if re.fullmatch("[a-z0-9]", c) else EDGE


def _ways(parsed) -> list[str]:
    """Ways through a parsed regular expression, as letters and digits, EDGE and ANYTHING."""
    out = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            ways = [_char(arg)]
        elif op is sre.IN:
            ways = []
            for kind, x in arg:
                if kind is sre.LITERAL:
                    ways.append(_char(x))
                elif kind is sre.RANGE and x[1] - x[0] < 128:
                    ways += map(_char, range(x[0], x[1] + 1))
                elif kind is sre.CATEGORY and x is sre.CATEGORY_SPACE:
                    ways.append(EDGE)
                else:
                    ways = [ANYTHING]
                    break
            if len(set(ways)) > 4:  # a class of many signs may be any of them
                ways = [ANYTHING]
        elif op is sre.AT and arg is not sre.AT_NON_BOUNDARY:
            ways = [EDGE]
        elif op is sre.BRANCH:
            ways = [w for x in arg[1] for w in _ways(x)]
        elif op is sre.SUBPATTERN:
            ways = _ways(arg[3])
        elif op is sre.ATOMIC_GROUP:
            ways = _ways(arg)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] <= 8:
            least, most, x = arg
            ways, once = [""], _ways(x)
            for _ in range(least):
                ways = _joined(ways, once)
            if most - least > 8:
                ways = _joined(ways, [ANYTHING])
            else:
                more = ways
                for _ in range(most - least):
                    more = _joined(more, once)
                    ways = [*ways, *more]
        else:
            ways = [ANYTHING]
        out = _joined(out, ways)
    return out


def _joined(a: list[str], b: list[str]) -> list[str]:
    b = list(dict.fromkeys(b))
    if len(a) * len(b) > MAX_WAYS:
        raise ValueError(f"more than {MAX_WAYS} ways through a regular expression")
    return list(dict.fromkeys(x + y for x in a for y in b))


def unheld(p: Pattern) -> list[str]:
    """Ways through the rule's regular expression that do not show all tokens of some alternative as whole ones."""
    whole = lambda way: set(re.findall(r"(?<=\|)[a-z0-9]+(?=\|)", way))
    return [w for w in _ways(_parser.parse(p.regex, FLAGS)) if not any(whole(w).issuperset(x) for x in p.entries)]


def index(df: DataFrame, patterns: list[Pattern]) -> dict[str, list[tuple[str, str]]]:
    """Rules as (name, regex) under that of their tokens which the fewest URLs of df contain, counted over all,
    once for each alternative."""
    if len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    for p in patterns:
        if any(not x or any(not re.fullmatch(TOKEN, t) for t in x) for x in p.entries):
            raise ValueError(f"rule {p.name} needs literal tokens of lower-case letters and digits")
    wanted = df.sparkSession.createDataFrame(sorted({(t,) for p in patterns for x in p.entries for t in x}), "t string")
    count = dict(df.select(F.explode(tokens()).alias("t")).join(F.broadcast(wanted), "t").groupBy("t").count().collect())
    out: dict[str, list[tuple[str, str]]] = {}
    for p in patterns:
        for t in dict.fromkeys(min(x, key=lambda t: (count.get(t, 0), t)) for x in p.entries):
            out.setdefault(t, []).append((p.name, p.regex))
    return out


def matching(df: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Adds patterns: the sorted names of the rules that match host and path, in either case of letters."""
    df = df.drop("patterns")
    if not patterns:
        return df.withColumn("patterns", F.array().cast("array<string>"))
    for p in patterns:
        if lost := unheld(p):
            raise ValueError(f"rule {p.name} may match without its tokens: {lost[0]}")
    rules = index(df, patterns)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {t: [(name, re.compile(x, FLAGS)) for name, x in rs] for t, rs in rules.items()}
        split = re.compile(TOKEN).findall
        for batch in batches:
            found = []
            for host, path in zip(batch["host"], batch["path"]):
                named = set()
                for t in compiled.keys() & split(f"{host} {path}".translate(_TO_LOWER)):
                    named.update(name for name, x in compiled[t] if x.search(host + path))
                found.append(sorted(named))
            yield batch.assign(patterns=found)

    return df.mapInPandas(judge, T.StructType([*df.schema.fields, T.StructField("patterns", T.ArrayType(T.StringType()))]))


def filter_urls(df: DataFrame, url: str = "url", rules=BASE_RULES, patterns: list[Pattern] | None = None) -> DataFrame:
    """Adds host, path, rule, verdict and patterns. A base rule that fits decides; else a matching pattern blocks."""
    out = matching(parts(df, url), PATTERNS if patterns is None else patterns).withColumn("_b", base_rule(rules))
    verdict = F.coalesce(F.col("_b.verdict"), F.when(F.size("patterns") > 0, "block").otherwise("allow"))
    return out.withColumns({"rule": F.col("_b.rule"), "verdict": verdict}).drop("_b")


def query(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


_LIKE = " OR ".join(f"regexp_matches(translate(host || path, '{UPPER}', '{LOWER}'), '{p.regex}')" for p in PATTERNS)
ORACLE = rf"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM b)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN {_LIKE} THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
