"""Personal data spans against plain Python."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from slotvalue.llm import pii

DOC = "doc_id bigint, text string"
EXTRA = "doc_id bigint, text string, row string, tried string, wide string, base string, masked string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = "".join(c for c in m.group() if c in "0123456789")
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[name]()
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if luhn(body + d))


def corpus(rng, n=160):
    """Documents with every kind in its usual form, and numbers that are none of them."""
    docs = []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "délta"]) for _ in range(12)]
        parts = [
            f"mail ab{i}@host{i % 7}.example.com", f"+1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}", card(rng),
            ".".join(str(rng.randrange(1, 255)) for _ in range(4)), str(rng.randrange(10**7, 10**9)), "300.1.2.999", f"{rng.randrange(10**15, 10**16)}",
        ]
        for p in rng.sample(parts, 4):
            words.insert(rng.randrange(len(words)), p + " so")
        docs.append((i, " ".join(words)))
    return docs


def spans(spark, docs, **more):
    rows = pii.span_digests(spark.createDataFrame(docs, DOC).repartition(3), **more).collect()
    return {(r.doc_id, r.base_sha256): r for r in rows}


@pytest.fixture(scope="module")
def model(spark):
    found = pii.candidates(spark.createDataFrame(corpus(random.Random(4), 400), DOC))
    found.write.mode("overwrite").parquet(path := pii.scratch_path(spark, "pii-test"))
    return pii.train(spark.read.parquet(path))


def test_base_spans_match_brute_force(spark):
    rng = random.Random(1)
    alphabet = ["1", "25", "4", "0", ".", ".", "-", " ", "  ", "+", "(", ")", "@", "a", "Z_", "ä", "😀", "\x01", "\n", "%", "4539578763621486", "192.168.0.1", "+1 (555) 123-4567", "x@y.z"]
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(700)]
    docs += [(800, None), (801, ""), (None, "a@b.c_d@e.f x@y@z.com"), (802, "1.2.3.4.5.6.7.8 0255.000.1.1 256.1.1.1"), (803, "1-2  " + "7" * 25 + " 4539 5787 6362 1486"), docs[5], docs[5]]
    rows = pii.span_digests(spark.createDataFrame(docs, DOC), model=pii.Model()).collect()
    want = []
    for i, t in docs:
        found = base(t)
        want.append((i, *[sum(k == x for _, x, _ in found) for k in range(4)], hashlib.sha256(listed(found).encode()).hexdigest(), listed(found), 0))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_starts_over_several_blocks(spark):
    text = "".join(f"1.2.3.{i % 256} ä" for i in range(700))
    row = pii.span_digests(spark.createDataFrame([(1, text)], DOC), model=pii.Model()).first()
    assert row.n_ip == 700 and row.spans == listed(base(text))
    sizes = [3] * 1000
    got = spark.createDataFrame([(sizes,)], "v array<bigint>").select(pii.running_starts(F.col("v"))).first()[0]
    assert got == [3 * i for i in range(1000)]


def test_spans_that_the_strict_patterns_lose_are_added(spark, model):
    a, b = card(random.Random(7)), card(random.Random(8))
    docs = [
        (1, f"see {a} {b} so"), (2, "ring +1 (555) 123-4567 10.20.30.40 so"), (3, "write ab9@host.example.com so"), (4, "mail ab7 (at) host3 (dot) example (dot) com so"),
        (5, "an order of 4539578763621487 and 1234567 items"), (6, "300.1.2.999 so"), (7, "no data at all"),
        (8, "ring (555) 123-4567 so or 555-123-4567 so"), (9, "number 5551234567 of 2020-2021"),
    ]
    got = {r.doc_id: [docs[r.doc_id - 1][1][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s] for r in pii.span_digests(spark.createDataFrame(docs, DOC), model=model).collect()}
    assert got[1] == [a, b]
    assert "+1 (555) 123-4567" in got[2] and "10.20.30.40" in got[2]
    assert got[3] == ["ab9@host.example.com"] and got[4] == ["ab7 (at) host3 (dot) example (dot) com"]
    assert got[5] == got[6] == got[7] == got[9] == []
    assert got[8] == ["(555) 123-4567", "555-123-4567"]


def test_base_spans_stay_and_additions_do_not_touch_them(spark):
    docs = corpus(random.Random(11), 120)
    texts = dict(docs)
    rows = pii.span_digests(spark.createDataFrame(docs, DOC)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        found = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        own = base(texts[r.doc_id])
        added = [s for s in found if s not in own]
        assert [s for s in found if s in own] == own and len(added) == r.n_added
        assert all(e <= a or b <= s for s, _, e in added for a, _, b in own)


def test_splits_and_leaves_match_a_direct_search():
    rng = random.Random(3)
    cells = [(rng.randrange(2), [rng.randrange(4) for _ in range(3)], rng.uniform(-1, 1), rng.uniform(0.1, 1)) for _ in range(80)]
    sums = {}
    for leaf, x, g, h in cells:
        for f, v in enumerate(x):
            a, b = sums.get((leaf, f, v), (0.0, 0.0))
            sums[leaf, f, v] = (a + g, b + h)
    options = []
    for f in range(3):
        for t in range(1, 4):
            gain, values = 0.0, []
            for side in (0, 1):
                for leaf in (0, 1):
                    rows = [(g, h) for at, x, g, h in cells if at == leaf and (x[f] >= t) == side]
                    g, h = sum(r[0] for r in rows), sum(r[1] for r in rows)
                    gain += g * g / (h + pii.RIDGE)
                    values.append(pii.RATE * g / (h + pii.RIDGE))
            options.append((gain, f, t, values))
    gain, f, t, values = max(options)
    got = pii._best_split(sums, 2)
    assert got[:2] == (f, t) and got[2] == pytest.approx(values, abs=1e-5)


def test_scores_follow_the_trees(spark):
    trees = [([0, 1, 2], [3, 1, 2], [float(i) for i in range(8)]), ([2, 2, 0], [1, 5, 1], [0.5 * i for i in range(8)])]
    m = pii.Model([trees, [], [], []], [0.0] * 4)
    rows = [(0, [i % 5, i % 3, i % 7]) for i in range(40)] + [(1, [1, 2, 3])]
    got = spark.createDataFrame(rows, "kind int, x array<int>").select("kind", "x", m.score(F.col("kind"), F.col("x")).alias("s")).collect()
    for r in got:
        want = sum(v[sum((r.x[f] >= t) << d for d, (f, t) in enumerate(zip(fs, ts, strict=True)))] for fs, ts, v in trees)
        assert r.s == (want if r.kind == 0 else 0.0)


def test_thresholds_keep_the_precision(model, spark):
    docs = corpus(random.Random(21), 300)
    found = pii.candidates(spark.createDataFrame(docs, DOC))
    cells = pii.examples(found, "doc_id")
    assert all(math.isfinite(x) for x in model.least)
    hit = model.score(F.col("kind"), F.col("x")) >= model.threshold(F.col("kind"))
    for r in cells.where(hit).groupBy("kind").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("p")).collect():
        assert r.p >= pii.PRECISION


def test_redaction_merges_overlapping_spans(spark):
    text = "ä write a@b.cd and +1 (555) 123-4567 now"
    out = pii.find(spark.createDataFrame([(1, text), (2, None), (3, "plain")], DOC), model=pii.Model())
    got = {r.d: r.t for r in out.select(F.col("row.doc_id").alias("d"), pii.redacted(F.col("row.text"), F.col("base")).alias("t")).collect()}
    assert got == {1: "ä write [EMAIL] and [PHONE] now", 2: None, 3: "plain"}
    overlapping = F.expr("array(struct(0 as kind, 2L as start, 5L as end), struct(1 as kind, 4L as start, 7L as end), struct(2 as kind, 9L as start, 10L as end))")
    assert spark.range(1).select(pii.redacted(F.lit("0123456789"), overlapping)).first()[0] == "01[EMAIL]78[CARD]"


def test_columns_pass_through_and_empty_tables(spark):
    table = spark.createDataFrame([(1, "a@b.cd", "r", "t", "w", "b", "m"), (None, None, None, None, None, None, None)], EXTRA)
    out = pii.find(table)
    assert out.columns == ["row", "base", "added"]
    assert sorted(map(str, map(tuple, out.select("row.*").collect()))) == sorted(map(str, map(tuple, table.collect())))
    assert pii.span_digests(spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("unit, n_ip", [("a", 0), ("7", 0), ("a@", 0), ("1.", 50_000), ("+1", 0), (" at ", 0), ("4 ", 0)])
def test_long_texts_take_linear_time(spark, unit, n_ip):
    text = unit * (400_000 // len(unit))
    row = pii.span_digests(spark.createDataFrame([(1, text)], DOC), model=pii.Model()).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (0, n_ip, 0, 0)


def test_no_python_on_the_executors(spark):
    plan = pii.span_digests(spark.createDataFrame(corpus(random.Random(1), 20), DOC))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_documents_of_many_candidates_teach_like_others(spark, monkeypatch):
    rng = random.Random(8)
    docs = corpus(rng, 24)
    whole = spark.createDataFrame([(1, " . ".join(text for _, text in docs * 12)), *docs[:6], (None, docs[7][1]), (2, None)], DOC)
    found = pii.candidates(whole).localCheckpoint()
    assert found.where(F.size("wide") + F.size("tried") > 256).count() == 1

    def cells(limit):
        monkeypatch.setattr(pii, "ROW_CANDIDATES", limit)
        return sorted((r.kind, r.held, tuple(r.x), r.y, r.n) for r in pii.examples(found, "doc_id").collect())

    within = cells(1 << 30)
    assert cells(256) == within and cells(0) == within
    assert sum(n for *_, n in within) > 500
