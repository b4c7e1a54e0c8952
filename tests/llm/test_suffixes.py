"""Suffix-array dedup against plain dictionaries of windows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hicweave.llm import suffixes

LAST = (1 << 63) - 1


def brute(rows, size, keep):
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept), sorted."""
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    windows = Counter(b[p : p + size] for _, b in texts for p in range(len(b) - size + 1))
    first = {}
    for i, b in texts:
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w not in first or (i, p) < first[w][:2]:
                first[w] = (i, p, b)
    out = []
    for (i, b), (key, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if windows[w] > 1 if keep == "none" else first[w][:2] < (i, p):
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((key, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def result(df, **more):
    out = suffixes.dedup(df, **more)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in out.collect()), key=str)


def documents(seed, n=60, alphabet="ab ", most=300):
    """Texts that share passages: some whole, some twice in one text, some ending with others' beginnings."""
    rnd = random.Random(seed)
    some = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    passages = [some(rnd.randrange(40, 200)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rnd.choice(passages)[rnd.randrange(10) :] if rnd.random() < 0.4 else some(rnd.randrange(most // 3)) for _ in range(rnd.randrange(5))]
        texts.append("".join(parts))
    return [(k * 7 % n, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_odd_rows(spark, odd, none, keep):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    more = [(None, rows[5][1]), (None, rows[14][1] * 2), (900, "y" * 5000), (901, "ab" * 3000)]
    df = odd.select("doc_id", "text", *[F.lit("mine").alias(c) for c in ("i", "t", "h", "spots", "kept", "n_bytes", "ranges", "data")])
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert result(df, keep=keep) == brute(rows + more, 400, keep)
    assert suffixes.dedup(none, keep=keep).count() == 0


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages(spark, seed, keep):
    rows = documents(seed) + documents(seed + 10, 20, "aé ")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, size=48, keep=keep) == brute(rows, 48, keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_frequent_passages_go_by_levels(spark, keep, monkeypatch):
    """Groups of three strings: copies of a passage meet over levels; a common core with other bytes behind is divided."""
    rnd = random.Random(3)
    some = lambda k: "".join(rnd.choice("abcdef") for _ in range(k))
    passage, head = some(90), some(46)
    rows = [(k, some(rnd.randrange(8)) + passage + some(5)) for k in range(60)]
    rows += [(100 + k, head + some(20)) for k in range(60)]
    rows += [(200 + k, rows[60 + k // 2][1] + some(2)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    divided, strings = suffixes.divided, []
    monkeypatch.setattr(suffixes, "divided", lambda rows, size: strings.append(rows.count()) or divided(rows, size))
    assert result(df, size=48, keep=keep, cap=3, group=10) == brute(rows, 48, keep)
    assert len(strings) > 2 and max(strings) > 20


def test_long_texts_go_by_stretches(spark, monkeypatch):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abc") for _ in range(3000))
    rows = [(1, long), (2, "x" * 50 + long[1000:1500] + "y" * 40), (3, long[2990:] + long[:60])]
    monkeypatch.setattr(suffixes, "STEP", 128)
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), size=48) == brute(rows, 48, "none")


@pytest.mark.parametrize("seed", range(6))
def test_order_and_factors(seed):
    """Suffix order, common beginnings, and longest previous factors by comparing all pairs."""
    rng = np.random.default_rng(seed)
    data, size = rng.integers(97, 97 + 1 + seed % 3, 160).astype(np.uint8), (16, 21, 40)[seed % 3]
    at = np.sort(rng.choice(160 - size + 1, 90, replace=False))
    text = [bytes(data[p : p + size]) for p in at]
    common = lambda a, b: next((k for k in range(size) if a[k] != b[k]), size)
    order, lcp = suffixes.suffix_order(suffixes.words_at(data), at, size)
    assert order.tolist() == sorted(range(len(at)), key=lambda k: (text[k], k))
    assert lcp[1:].tolist() == [common(text[a], text[b]) for a, b in zip(order, order[1:])]
    for least in (1, 9, size):
        want = [max((common(text[k], text[j]) for j in range(k)), default=0) for k in range(len(at))]
        assert suffixes.previous_factors(order, lcp, least).tolist() == [w if w >= least else 0 for w in want]
    earlier, later = suffixes.copies(data, at, size)
    assert earlier.tolist() == [text[k] in text[:k] for k in range(len(at))]
    assert later.tolist() == [text[k] in text[k + 1 :] for k in range(len(at))]


def test_cut():
    assert suffixes.cut(b"abcdefghij", [(0, 3), (1, 4), (4, 5), (7, 9)]) == (7, 2, b"fgj")
    with pytest.raises(ValueError):
        suffixes.spread(40)
