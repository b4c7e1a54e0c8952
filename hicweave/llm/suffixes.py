"""Suffix-array dedup: which strings of `size` bytes also start elsewhere, in any document, by longest-previous-factor arrays.

Strings of `size` bytes are windows. A window's anchor is the place of the least hash of GRAM bytes among its first
bytes, the leftmost of equals; its core is what follows the anchor and lies in every window with this anchor. Equal
windows have equal cores, so cores are counted first, with partial counts, and only windows around cores that occur twice
or more go on: neighbours with one anchor as one string, to a group with those of their core. A group takes equal strings
as one, leaves windows whose hash is theirs alone, puts the suffixes that begin with the others in order by their first
`size` bytes and finds, for each, the previous and the next one in this order that
begin earlier in the corpus: the longer of the two common beginnings is its longest previous factor. Windows whose factor
is a whole window are later copies; the mirror image finds those with copies behind them. Documents are in order of their
ids, so that `keep` may keep the first copy ("first") or none ("none").

No group is larger than CAP strings of a core: those of a frequent core are dealt out by document, each group settles its
own copies and sends one of each on, until few are left. Where that hardly shrinks them, because what follows a common
core differs, windows are divided by longer cores, down to whole windows, and cores that occur once go.

Null texts count as empty; shorter ones than a window lose nothing; longer ones than STEP are worked on in stretches, and
matches cross stretches but never documents. Null ids come last. Rows that share id and text share their result: with
"first" neither is the other's copy, with "none" each is. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spend, table, trimmed
from .substrings import mixed, ranges

SIZE = 400
GRAM = 16
#: Windows of a stretch of a long text, and bytes that a task works on at a time; places in them take PLACE_BITS.
STEP, CHUNK, PLACE_BITS = 1 << 20, 1 << 18, 22
#: Strings of one core that a group holds, and strings of all its cores.
CAP, GROUP = 2048, 4096
LAST = (1 << 63) - 1
_MIX, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def spread(size: int) -> int:
    """First bytes of a window among which its anchor is sought."""
    if size < 3 * GRAM:
        raise ValueError(f"windows have {3 * GRAM} bytes or more")
    return 3 * size // 5


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian numbers."""
    two = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    return four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]


def anchors(words: np.ndarray, size: int) -> np.ndarray:
    """The anchor of the window that begins at each place. Hashes are cut to make room for places, so that the least of
    both together is the leftmost least hash."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    low = words[: -(GRAM - 8)] * _MIX ^ words[GRAM - 8 :] * _AGAIN
    low ^= low >> np.uint64(32)
    low *= _MIX
    low &= ~mask
    low |= np.arange(len(low), dtype=np.uint64)
    width, wanted = 1, spread(size)
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = wanted - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & mask).astype(np.int64)


def core_hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the bytes from an anchor on that every window with this anchor holds."""
    length, out = size - spread(size) + 1, np.zeros(len(at), np.uint64)
    for j in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        out = (out ^ words[at + j]) * _MIX
        out ^= out >> np.uint64(32)
    return mixed(out)


class Stretches:
    """Stretches of texts, one after the other: whose text, from which byte on, where it lies in `data`, and its windows."""

    def __init__(self, size: int) -> None:
        self.size, self.held = size, 0
        self.parts: list[np.ndarray] = []
        self.rows: list[tuple[int, int, int, int]] = []

    def add(self, row: int, base: int, text: np.ndarray) -> None:
        self.rows.append((row, base, self.held, len(text) - self.size + 1))
        self.parts.append(text)
        self.held += len(text)

    def runs(self) -> tuple[np.ndarray, ...]:
        """data, its words, and of each run of windows with one anchor: row, anchor, first window (both in data), windows,
        and the text's place less that in data."""
        data = np.concatenate(self.parts)
        words = words_at(data)
        anchor = anchors(words, self.size)
        row, base, begin, count = np.array(self.rows, np.int64).T
        start = ranges(begin, count)
        a = anchor[start]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))  # stretches have anchors of their own
        whose = np.repeat(np.arange(len(row)), count)[first]
        return data, words, row[whose], a[first], start[first], np.diff(np.append(first, len(a))), (base - begin)[whose]


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text, without copies; null ones are empty."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    yield from (data[a:b] for a, b in zip(offsets, offsets[1:]))


def _chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, Stretches]]:
    """The column `text` in lots of about CHUNK bytes; rows count within their batch."""
    for batch in batches:
        held = Stretches(size)
        for k, text in enumerate(texts_of(batch.column("text"))):
            for base in range(0, len(text) - size + 1, STEP):
                part = text[base : base + STEP + size - 1]
                if held.held and held.held + len(part) > CHUNK:
                    yield batch, held
                    held = Stretches(size)
                held.add(k, base, part)
        if held.held:
            yield batch, held


def suffix_order(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at `at` by their first size bytes, of equals the earlier one first, and the
    length of what each has in common, within these bytes, with the one before it.

    Suffixes are sorted by eight bytes at a time; those that no longer tie with a neighbour are left alone.
    """
    key = words[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]]) if len(at) else np.zeros(0, bool)
    lcp = np.zeros(len(at), np.int64)
    new = np.flatnonzero(~same[1:]) + 1
    lcp[new] = _common(key[new], key[new - 1])
    live = np.flatnonzero(same | np.append(same[1:], False))
    for offset in [*range(8, size - 7, 8), *([size - 8] if size % 8 else [])]:
        if not len(live):
            break
        k = words[at[order[live]] + offset]
        tied = same[live]
        if (tied[1:] & (k[1:] < k[:-1])).any():
            p = np.lexsort((k, np.cumsum(~tied)))
            order[live], k = order[live][p], k[p]
        split = np.flatnonzero(tied[1:] & (k[1:] != k[:-1])) + 1
        same[live[split]] = False
        lcp[live[split]] = offset + _common(k[split], k[split - 1])
        tied = same[live]
        live = live[tied | np.append(tied[1:], False)]
    lcp[same] = size
    return order, lcp


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of big-endian numbers."""
    x = a ^ b
    return sum(((x >> np.uint64(s)) == 0).astype(np.int64) for s in range(0, 64, 8))


def _nearest_smaller(place: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each rank, what it has in common with the nearest rank before it of a smaller place; 0 where that is less than
    `least`. A rank whose candidate is no smaller takes that one's candidate: all between are larger than either."""
    before = np.where(lcp >= least, np.arange(len(place)) - 1, -1)
    low = lcp.copy()
    open_ = np.flatnonzero(before >= 0)
    while len(open_ := open_[place[before[open_]] > place[open_]]):
        j = before[open_]
        low[open_] = np.minimum(low[open_], low[j])
        before[open_] = before[j]
        open_ = open_[before[open_] >= 0]
    return np.where(before >= 0, low, 0)


def previous_factors(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """The longest previous factor of each suffix, by its place: the longest beginning that an earlier suffix shares, from
    the previous and the next smaller place in suffix order; factors shorter than `least` count as none."""
    behind = _nearest_smaller(order, lcp, least)
    ahead = _nearest_smaller(order[::-1], np.concatenate([[0], lcp[1:][::-1]]) if len(lcp) else lcp, least)[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(behind, ahead)
    return out


def window_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window, from its bytes alone: differences of prefix sums, moved to one origin."""
    power = np.cumprod(np.full(len(data) + 1, _MIX), dtype=np.uint64)
    back = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(_MIX), -1, 1 << 64))), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return (sums[at + size] - sums[at]) * back[at]


def copies(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that begin at `at`, in the order in which they count as earlier and later: which have an earlier
    copy, and which a later one. Windows whose hash is theirs alone have none and stay out of the suffix order."""
    earlier, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    hashes = window_hashes(data, at, size)
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes)
        order, lcp = suffix_order(words_at(data), at[some], size)
        earlier[some] = previous_factors(order, lcp, size) >= size
        later[some] = (previous_factors(len(some) - 1 - order, lcp, size) >= size)[::-1]
    return earlier, later


SEGMENT = "h bigint, n bigint, width int, i bigint, t bigint, anchor int, at int, windows int, data binary"
_FIELDS = [c.split()[0] for c in SEGMENT.split(", ")]
#: What a group gives: byte ranges to remove, or strings that go on, with the number of their core's strings before.
SETTLED = "i bigint, t bigint, a int, b int, h bigint, width int, anchor int, at int, windows int, data binary, was bigint"
_SETTLED = pa.schema([(c, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for c, k in (f.split() for f in SETTLED.split(", "))])


def _binary(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """Slices of data as one column."""
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[ranges(begin, length)]))])


def cores(df: DataFrame, size: int) -> DataFrame:
    """h, i, t, anchor of every core of (i, t, text)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in _chunked(batches, size):
            _, words, row, anchor, _, _, shift = held.runs()
            whose = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(core_hashes(words, anchor, size).view(np.int64)), batch.column("i").take(whose), batch.column("t").take(whose), pa.array((anchor + shift).astype(np.int32))], ["h", "i", "t", "anchor"])

    return df.select("i", "t", "text").mapInArrow(run, "h bigint, i bigint, t bigint, anchor int")


def segments(df: DataFrame, size: int) -> DataFrame:
    """The windows around the anchors that `spots`, an array of (anchor, n) for each row of (i, t, text), lists: a string
    for each, with the number n of its core's strings."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in _chunked(batches, size):
            data, words, row, anchor, start, windows, shift = held.runs()
            spots = batch.column("spots")
            place, count = (spots.flatten().field(c).to_numpy() for c in ("anchor", "n"))
            key = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy())) << 32 | place  # sorted
            mine = row << 32 | (anchor + shift)
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            hit = np.flatnonzero(key[at] == mine)
            if not len(hit):
                continue
            whose = pa.array(row[hit])
            n = windows[hit]
            arrays = [
                pa.array(core_hashes(words, anchor[hit], size).view(np.int64)), pa.array(count[at[hit]]), pa.array(np.full(len(hit), spread(size), np.int32)), batch.column("i").take(whose), batch.column("t").take(whose),
                pa.array((anchor + shift)[hit].astype(np.int32)), pa.array((start + shift)[hit].astype(np.int32)), pa.array(n.astype(np.int32)), _binary(data, start[hit], n + size - 1),
            ]
            yield pa.RecordBatch.from_arrays(arrays, _FIELDS)

    return df.select("i", "t", "text", "spots").mapInArrow(run, SEGMENT)


def _runs_of(mask: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the runs of true that stay within a segment."""
    edge = np.concatenate([[True], segment[1:] != segment[:-1]]) if len(mask) else mask
    begin = np.flatnonzero(mask & (edge | np.concatenate([[True], ~mask[:-1]]))) if len(mask) else np.zeros(0, np.int64)
    return begin, np.add.reduceat(mask, begin, dtype=np.int64) if len(begin) else begin


def _settled(group: pa.Table, size: int, keep: str) -> pa.Table:
    """Rows (i, t, a, b) to remove, and, of groups that hold a part of a core's strings only (`part`), rows of strings
    that go on: one of each window."""
    columns = {c: group.column(c).to_numpy().astype(np.int64) for c in ("h", "n", "width", "i", "t", "anchor", "at", "windows")}
    rank = np.lexsort((columns["windows"], columns["at"], columns["t"], columns["i"]))
    columns = {c: v[rank] for c, v in columns.items()}
    if keep == "first" and len(rank):  # rows that share id and text are no copies of each other
        same = np.all([columns[c][1:] == columns[c][:-1] for c in ("i", "t", "at", "windows", "h")], axis=0)
        fresh = np.concatenate([[True], ~same])
        rank, columns = rank[fresh], {c: v[fresh] for c, v in columns.items()}
    # Equal strings are taken as one, in the order of the first of each.
    coded = group.column("data").combine_chunks().take(pa.array(rank)).dictionary_encode()
    code, texts = coded.indices.to_numpy(), coded.dictionary
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = np.unique(code, return_index=True)[1]
    often = np.bincount(code, minlength=len(first)) > 1
    count = columns["windows"][first]
    begin = np.cumsum(count + size - 1) - (count + size - 1)
    at, string, place = ranges(begin, count), np.repeat(np.arange(len(count)), count), ranges(np.zeros(len(count), np.int64), count)
    earlier, later = copies(data, at, size)

    def rows(whose: np.ndarray, **have) -> pa.Table:
        have |= {"i": columns["i"][whose], "t": columns["t"][whose]}
        return pa.table([pa.array(have[f.name], f.type) if f.name in have else pa.nulls(len(whose), f.type) for f in _SETTLED], schema=_SETTLED)

    def removed(whose: np.ndarray, mask: np.ndarray) -> pa.Table:
        """Runs of a string's windows, for each of its rows in whose."""
        s, n = _runs_of(mask, string)
        own = np.bincount(string[s], minlength=len(count))
        c = code[whose]
        run, row = ranges((np.cumsum(own) - own)[c], own[c]), np.repeat(whose, own[c])
        a = columns["at"][row] + place[s[run]]
        return rows(row, a=a, b=a + n[run] + size - 1)

    if keep == "none":
        out = [removed(np.arange(len(code)), earlier | later | often[string])]
    else:
        others = np.ones(len(code), bool)
        others[first] = False
        out = [removed(first, earlier), removed(np.flatnonzero(others), np.ones(len(at), bool))]
    if group.column("part")[0].as_py():
        s, n = _runs_of(~earlier, string)
        whose = first[string[s]]
        own = {c: columns[c][whose] for c in ("h", "width", "anchor")}
        out.append(rows(whose, **own, at=columns["at"][whose] + place[s], windows=n, data=_binary(data, at[s], n + size - 1), was=columns["n"][whose]))
    return pa.concat_tables(out)


def divided(rows: DataFrame, size: int) -> DataFrame:
    """Strings cut by how far their windows begin before the anchor, so that cores are longer; the core of a width of one
    is the window."""
    import xxhash

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                width = max(1, r["width"] // 8)
                low, high = r["anchor"] - (r["at"] + r["windows"] - 1), r["anchor"] - r["at"]
                for j in range(low // width, high // width + 1):
                    begin = max(r["at"], r["anchor"] - (j + 1) * width + 1)
                    stop = min(r["at"] + r["windows"], r["anchor"] - j * width + 1)
                    shift = r["at"]
                    core = r["data"][r["anchor"] - j * width - shift : r["anchor"] - (j + 1) * width + 1 + size - shift]
                    h = xxhash.xxh3_64_intdigest(core, (r["h"] ^ j) & (1 << 64) - 1)
                    out.append((h - (1 << 64) if h >> 63 else h, r["n"], width, r["i"], r["t"], r["anchor"], begin, stop - begin, r["data"][begin - shift : stop - shift + size - 1]))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], _FIELDS)

    return rows.select(*_FIELDS).mapInArrow(run, SEGMENT)


def repeats(df: DataFrame, size: int = SIZE, keep: str = "none", cap: int = CAP, group: int = GROUP) -> DataFrame:
    """i, t, ranges: of each (i, t, text) with something to remove, the byte ranges [a, b), sorted; they may overlap."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    every = materialise(cores(df, size), "cores")
    common = materialise(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    spots = every.join(common, "h").groupBy("i", "t").agg(F.sort_array(F.collect_set(F.struct("anchor", "n"))).alias("spots"))
    rows = common.agg(F.sum("n")).collect()[0][0] or 0
    now, done, old = segments(df.join(spots, ["i", "t"]), size), None, [every, common]
    while True:
        parts = F.when(F.col("n") > cap, F.ceil(F.col("n") / cap))
        dealt = now.select(
            *_FIELDS, F.pmod("h", F.lit(max(1, -(-rows // group)))).alias("bucket"), F.when(F.col("n") > cap, F.col("h")).alias("hot"),
            F.pmod(F.xxhash64("i", "t", "at", "anchor"), parts).alias("salt"), (F.col("n") > cap).alias("part"),
        )
        settled = materialise(dealt.groupBy("bucket", "hot", "salt").applyInArrow(lambda g: _settled(g, size, keep), SETTLED), "settled")
        spend(*old)
        found = settled.filter("a is not null").select("i", "t", F.struct("a", "b").alias("r"))
        done = found if done is None else done.unionByName(found)
        left = settled.filter("h is not null")
        if not left.limit(1).count():
            break
        # The strings that are left of a core; where they hardly shrank, they are divided and counted anew.
        shrunk = left.join(left.groupBy("h", "width").agg(F.count("*").alias("n")).filter("n > 1"), ["h", "width"])
        stuck = (F.col("n") > cap) & (2 * F.col("n") > F.col("was")) & (F.col("width") > 1)
        finer = materialise(divided(shrunk.filter(stuck), size), "divided")
        again = finer.groupBy("h", "width").agg(F.count("*").alias("n")).filter("n > 1")
        now = materialise(shrunk.filter(~stuck).select(*_FIELDS).unionByName(finer.drop("n").join(again, ["h", "width"]).select(*_FIELDS)), "segments")
        rows, old = now.count(), [finer, now]
    return done.groupBy("i", "t").agg(F.sort_array(F.collect_set("r")).alias("ranges"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left; spans are sorted and may overlap."""
    removed, runs, stay, at = 0, 0, [], 0
    end = -1
    for a, b in spans:
        if a > end:
            runs += 1
            stay.append(text[at:a])
            end = a
        removed += max(0, b - max(a, end))
        end = max(end, b)
        at = end
    stay.append(text[at:])
    return removed, runs, b"".join(stay)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, keep: str = "none", **limits) -> DataFrame:
    """key, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary) of every row. Bytes go that a window
    covers which has a copy: with keep "none" anywhere else, with "first" earlier, that is in a document with a smaller id
    or before in its own."""
    i = F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("i")
    docs = df.select(F.col(key).alias("key"), i, F.xxhash64(text).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gone = materialise(repeats(docs.filter(F.octet_length("text") >= size), size, keep, **limits), "ranges")
    joined = docs.join(gone, ["i", "t"], "left").select("key", "text", F.col("ranges.a").alias("a"), F.col("ranges.b").alias("b"))
    kind = dict(df.select(key).dtypes)[key]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 512):
                part = batch.slice(j, 512)
                texts = part.column(1).cast(pa.binary())
                rows = [(0, 0, x) if a is None else cut(x, list(zip(a, b))) for x, a, b in zip(texts.to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(texts).cast(pa.int64()), *columns], [key, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, s, md5(substr(x, 2 * s + 1, {2 * SIZE})) AS g FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - {SIZE - 1})) AS s FROM d WHERE len(x) >= {2 * SIZE})),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
k AS (SELECT rid, s, sum(CASE WHEN s <= before + {SIZE} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS run
  FROM (SELECT rid, s, lag(s) OVER (PARTITION BY rid ORDER BY s) AS before FROM r)),
i AS (SELECT rid, min(s) AS a, max(s) + {SIZE} AS b FROM k GROUP BY rid, run),
p AS (SELECT rid, b AS a, lead(a) OVER (PARTITION BY rid ORDER BY a) AS b FROM i UNION ALL SELECT rid, 0, min(a) FROM i GROUP BY rid),
t AS (SELECT rid, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, len(x) // 2) - a)), '' ORDER BY a) AS y FROM p JOIN d USING (rid) GROUP BY rid),
n AS (SELECT rid, sum(b - a) AS n, count(*) AS c FROM i GROUP BY rid)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN n USING (rid)
"""
