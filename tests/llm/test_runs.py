"""Periodic runs against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotvalue.llm import runs

DOC = "doc_id bigint, text string"
EXTRA = "doc_id bigint, text string, row string, found string, runs string"
SPACE = set(" \t\n\x0b\f\r")


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c not in SPACE:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(w, least_words=6, least_exponent=4):
    """Every maximal stretch of every period, without those that have a smaller period."""
    out = []
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_words, least_exponent * q):
                if all(any(w[x] != w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted((s, n, q) for s, n, q in out)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, w):
    found = brute(w)
    keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(keep)))


def repetitive(rng, size=40):
    base = [rng.choice(["a", "b", "ä", "dd"][: rng.randrange(1, 5)]) for _ in range(rng.randrange(size))]
    for _ in range(rng.randrange(4)):
        a = rng.randrange(len(base) + 1)
        base[a:a] = base[a : a + rng.randrange(1, 9)] * rng.randrange(1, 7)
    return base


def test_core_matches_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        docs = [repetitive(rng) for _ in range(rng.randrange(1, 4))]
        first = np.cumsum([0] + [len(d) for d in docs])
        names = sorted({w for d in docs for w in d})
        codes = np.array([names.index(w) for d in docs for w in d], np.int64)
        got = [tuple(map(int, r)) for r in runs.periodic_runs(codes, first)]
        assert got == sorted((s + int(f), n, q) for d, f in zip(docs, first, strict=False) for s, n, q in brute(d))


def test_low_exponents_are_refused():
    with pytest.raises(ValueError):
        runs.periodic_runs(np.zeros(9, np.int64), np.array([0, 9]), least_exponent=3)


def test_digests_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(runs, "SLICE_BYTES", 300)
    rng = random.Random(2)
    docs = [(i, " ".join(repetitive(rng, 60))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (None, "x " * 9), (203, "\x1cy y\x0by\fy y\ry y\x85"), (204, "b a b a b a b a c c c c c c")]
    docs += [docs[3], docs[3], (3, "another text of the same id")]
    table = spark.createDataFrame(docs, DOC).repartition(3)
    got = runs.run_digests(table, text=runs.with_planted_runs()).collect()
    want = [digest(i, planted(i, words_of(t))) for i, t in docs]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.n_runs > 0 for r in got) > 20 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150))


def test_ties_prefer_the_first_run(spark):
    got = runs.run_digests(spark.createDataFrame([(1, "a a a a a a b c d c d c d c d c d c d")], DOC)).first()
    assert (got.start, got.length, got.period, got.n_runs) == (0, 6, 1, 2)


def test_columns_with_clashing_names_pass_through(spark):
    table = spark.createDataFrame([(1, "k k k k k k k", "r", "f", "x"), (None, None, None, None, None)], EXTRA)
    out = runs.find_runs(table)
    assert out.columns == ["row", "n_words", "runs", "collapsed"]
    got = sorted(out.select("row.*", F.col("collapsed").alias("c"), F.size("runs").alias("n")).collect(), key=lambda r: str(r.doc_id))
    assert [tuple(r) for r in got] == [(1, "k k k k k k k", "r", "f", "x", "k", 1), (None, None, None, None, None, "", 0)]


def test_empty_tables(spark):
    assert runs.run_digests(spark.createDataFrame([], DOC)).collect() == []
    assert len(runs.run_digests(spark.createDataFrame([], DOC)).columns) == 8


def test_a_very_long_text(spark):
    rng = random.Random(5)
    head = [f"w{rng.randrange(500)}" for _ in range(60_000)]
    block = [f"v{i}" for i in range(20_000)]
    got = runs.run_digests(spark.createDataFrame([(1, " ".join(head + block * 5)), (2, "z " * 200_000)], DOC)).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [(1, 1, 60_000, 100_000, 20_000, 5000), (2, 1, 0, 200_000, 1, 200_000_000)]
    assert got[0].collapsed_sha256 == hashlib.sha256(" ".join(head + block).encode()).hexdigest()
