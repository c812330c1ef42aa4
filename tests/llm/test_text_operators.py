"""Shingles, line deduplication, similarity join, decontamination and chunks against plain Python."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotvalue.llm import chunks, decontam, lines, neardup, tokens
from tests.llm import brute

DOC = "doc_id bigint, text string"
EXTRA = "doc_id bigint, text string, doc string, tag string, row string, keep string"


def prose(rng, words):
    return " ".join(rng.choice(["ab", "Cd", "éf", "gh1", "ij", "kl", "mn", "op", "qr", "st"]) + str(rng.randrange(60)) for _ in range(words))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 .éÉ\n-ß漢", max_size=40)), max_size=8))
def test_shingles_follow_the_definition(texts):
    found = tokens.words(pa.array(texts, pa.string()))
    sets = tokens.shingles(found)
    for i, text in enumerate(texts):
        own = [found.text(k).decode() for k in range(found.first[i], found.first[i + 1])]
        assert own == brute.WORD.findall((text or "").lower())
        assert len(set(sets.hashes[sets.first[i] : sets.first[i + 1]].tolist())) == len(brute.shingles(text))


def test_equal_shingles_hash_alike_wherever_they_stand():
    found = tokens.shingles(tokens.words(pa.array(["x a b c d e", "a b c d e y", "", None, "a b", "a b"], pa.string())))
    hashes, first = tokens.distinct_sets(found)
    parts = [set(hashes[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert len(parts[0] & parts[1]) == 1 and not parts[2] and not parts[3] and parts[4] == parts[5]
    assert list(tokens.slices(pa.array(["ab", None, "", "abcdef", "a"], pa.string()), 3)) == [(0, 3), (3, 4), (4, 5)]


# --- lines -----------------------------------------------------------------------------


def line_documents():
    rng = random.Random(5)
    shared = ["A line that many documents share, number %d of a few" % k for k in range(6)]
    docs = [(i, "\n".join(rng.choice([*shared, f"own line {i} {rng.random()} which is long enough to count", "short", ""]) for _ in range(rng.randrange(9)))) for i in range(60)]
    docs += [(3, " \t" + shared[0].upper() + "\r\nx"), (3, docs[3][1]), (None, shared[1] + "\n" + shared[1]), (None, None), (90, None), (91, ""), (92, "\n\n")]
    docs += [(100 + i, "é" * 39 + "\n" + "é" * 40 + "\n" + "漢" * 13) for i in range(5)]
    return docs


def test_lines_match_brute_force(spark):
    docs = line_documents()
    got = sorted(map(tuple, lines.line_digests(spark.createDataFrame(docs, DOC).repartition(5)).collect()), key=str)
    want = [(i, n, d, hashlib.sha256(kept.encode()).hexdigest()) for i, n, d, kept in brute.dedup_lines(docs)]
    assert got == sorted(want, key=str)


def test_a_line_of_most_documents_spans_ranges(spark):
    docs = [(i, "the same long line in every single document\n" * 3 + str(i)) for i in range(400)]
    got = {r.doc_id: r.n_dropped for r in lines.line_digests(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {i: 0 if i == 399 else 3 for i in range(400)}


def test_decisions_do_not_depend_on_batches():
    rng = np.random.default_rng(4)
    schema = pa.schema([(n, pa.int64()) for n in ("h1", "h2", "doc", "tag", "pos", "n_lines")])
    out = pa.schema([(n, pa.int64()) for n in ("doc", "tag", "pos", "n_lines")])
    for trial in range(60):
        rows = [(k % 3, k, d, 0, p, 9) for k in range(6) for d in rng.integers(0, 9, rng.integers(1, 12)) for p in range(rng.integers(1, 4))]
        rows = sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[4]))
        holders = {}
        for r in rows:
            holders.setdefault(r[:2], set()).add(r[2])
        # The keys at the edges of a partition are known; here they also have a document elsewhere.
        totals = {k: (len(holders[k]) + trial % 2, max(holders[k]) + trial % 2) for k in (rows[0][:2], rows[-1][:2])}
        known = {k: totals.get(k, (len(v), max(v))) for k, v in holders.items()}
        want = sorted((r[2], r[3], r[4], r[5]) for r in rows if known[r[:2]][0] >= 4 and r[2] != known[r[:2]][1])
        size = int(rng.integers(1, 9))
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], schema=schema) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in lines._dropped(totals, 4)(iter(batches), out) for r in b.to_pylist()]
        assert sorted(got) == want


def test_a_long_run_is_not_held():
    carry, dropped = None, 0
    for i in range(50):
        doc = np.arange(10**6 - 1000 * i, 10**6 - 1000 * (i + 1), -1)
        cols = [np.full(1000, 1), np.full(1000, 2), doc, *[np.zeros(1000, np.int64)] * 3]
        parts, carry = lines._decide(cols, carry, {}, 5)
        dropped += sum(len(p[0]) for p in parts)
        assert carry.waiting == []
    assert dropped == 49_999


def test_a_frequent_line_spans_batches_and_ranges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        line = "the same long line in every single document of the table"
        docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\n"), F.col("id").cast("string")).alias("text"))
        got = lines.line_digests(docs).groupBy("n_dropped").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).collect()
        assert {(r.n_dropped, r.n, r.last) for r in got} == {(1, 49_999, 49_998), (0, 1, 49_999)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_filtered_rows_keep_their_columns(spark):
    docs = line_documents()
    table = spark.createDataFrame([(i, t, "d", "t", "r", "k") for i, t in docs], EXTRA)
    out = lines.apply_bitmaps(table, lines.keep_bitmaps(table))
    assert out.columns == table.columns
    want = [(i, t if t is None else kept, "d", "t", "r", "k") for (i, t), (_, _, _, kept) in zip(docs, brute.dedup_lines(docs), strict=True)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert lines.line_digests(spark.createDataFrame([], DOC)).collect() == []


def test_bitmaps_round_trip():
    for n, gone in ((1, [0]), (9, [1, 8]), (20_000, list(range(0, 20_000, 3)))):
        keep = lines.unpack(lines.pack(gone, n), n)
        assert np.flatnonzero(~keep).tolist() == gone and len(keep) == n


# --- similarity join -------------------------------------------------------------------


def near_documents(groups=12, size=7):
    rng = random.Random(11)
    docs = []
    for _ in range(groups):
        base = prose(rng, rng.randrange(30, 200)).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            docs.append((len(docs), " ".join(words)))
    docs += [(len(docs) + i, prose(rng, 40)) for i in range(30)]
    docs += [(500, docs[0][1]), (500, docs[0][1]), (501, docs[0][1].upper()), (502, None), (503, ""), (504, "..."), (505, "two words"), (506, "Two words!"), (None, docs[9][1])]
    return docs


@pytest.mark.parametrize(("cell", "large"), [(4, 1024), (4, 2), (256, 1024)])
def test_similar_documents_match_brute_force(spark, monkeypatch, cell, large):
    # Groups of 7: as one label with cells of its own, cut into several cells, and together with other labels.
    monkeypatch.setattr(neardup, "CELL_MEMBERS", cell)
    monkeypatch.setattr(neardup, "LARGE_MEMBERS", large)
    docs = near_documents()
    got = sorted(map(tuple, neardup.document_classes(spark.createDataFrame(docs, DOC).repartition(4)).collect()), key=str)
    assert got == sorted(((i, c, n) for (i, _), (c, n) in brute.classes(docs).items()), key=str)


def test_one_of_each_class_stays(spark):
    docs = near_documents(4)
    table = spark.createDataFrame([(i, t, "d", "t", "r", "k") for i, t in docs], EXTRA)
    out = neardup.one_of_each(table)
    found = brute.classes(docs)
    heads = {}
    for (i, t), (c, _) in sorted(found.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        heads.setdefault((c, tuple(sorted(map(str, brute.shingles(t)))) if c == i else None), (i, t))
    assert out.columns == table.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert got == {(i, t) for (i, t), (c, _) in found.items() if c == i}
    assert neardup.document_classes(spark.createDataFrame([], DOC)).collect() == []


def test_a_large_group_makes_no_pairs(spark):
    rng = random.Random(2)
    base = prose(rng, 60).split()
    docs = [(i, " ".join([*base, f"tail{i}"])) for i in range(700)]
    got = {(r.class_id, r.n_links) for r in neardup.document_classes(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {(0, 699)}


def test_differences_count_like_whole_sets():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**40, 300).astype(np.uint64))
    sets, marks, removed = [], [], []
    for _ in range(40):
        lacks = rng.choice(base, rng.integers(0, 60), replace=False)
        beyond = np.setdiff1d(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64), base)
        own = np.union1d(np.setdiff1d(base, lacks), beyond)
        sets.append(own)
        marks.append(np.concatenate([np.setdiff1d(base, own), np.setdiff1d(own, base)]))
        removed.append(len(np.setdiff1d(base, own)))
    ends = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for side in (np.zeros(40, int), rng.integers(0, 2, 40)):
        whole = neardup.verify_tile(side, np.concatenate(sets), ends(sets), np.arange(1, 41), 0.8)
        short = neardup.verify_tile(side, np.concatenate(marks), ends(marks), np.arange(1, 41), 0.8, np.array([len(s) for s in sets]), np.array(removed))
        assert (whole[0] == short[0]).all() and (whole[1] == short[1]).all() and whole[0].any()


def test_bands_reach_the_recall():
    n = neardup.bands_for(0.8)
    assert 1 - (1 - 0.8**neardup.ROWS) ** n >= neardup.TARGET_RECALL > 1 - (1 - 0.8**neardup.ROWS) ** (n - 1)


# --- decontamination -------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_contained_items_match_brute_force(spark, monkeypatch, bits):
    # With 64 bits the map knows nearly every shingle, and the joins alone decide.
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 3, 5, 6, 14, 40, 59, 100])] + [(20, None), (21, "--"), (5, prose(rng, 12))]
    items += [items[4], (None, items[5][1])]
    docs = [(0, None), (1, ""), (2, prose(rng, 3000)), (None, items[5][1])]
    for k, (_, text) in enumerate(items[:8]):
        around = prose(rng, 400)
        words = text.split()
        for cut in (0, 1, max(1, len(words) // 6), len(words) // 3):
            docs.append((100 + 10 * k + cut, around + " " + " ".join(words[cut:]).upper() + ". " + prose(rng, 20)))
        docs.append((9, text))
    docs += [docs[-1], (7, items[0][1] * 30_000)]
    tables = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(brute.contained(docs, items), key=str)
    assert sorted(map(tuple, decontam.contained_items(*tables).collect()), key=str) == want
    gone = {d for d, *_ in want}
    kept = decontam.drop_contaminated(*tables)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(d) for d in docs if d[0] not in gone)
    empty = spark.createDataFrame([], DOC)
    assert decontam.contained_items(empty, tables[1]).isEmpty() and decontam.contained_items(tables[0], spark.createDataFrame([], "item_id bigint, text string")).isEmpty()


def test_signatures_cannot_miss():
    for n in range(1, 300):
        assert decontam.signature_size(decontam.size_class(n), 0.8) > n - int(np.ceil(0.8 * n - 1e-9))


# --- chunks ----------------------------------------------------------------------------


def cut(text):
    data, offsets = tokens.utf8(pa.array([text], pa.string()))
    _, start, end = chunks.cut_points(data, offsets)
    return [text.encode()[a:b] for a, b in zip(start, end, strict=True)]


def test_cuts_survive_insertions():
    rng = random.Random(4)
    text = prose(rng, 3000)
    parts = cut(text)
    assert b"".join(parts).decode() == text and all(p.decode() and len(p) <= chunks.MOST for p in parts)
    assert all(len(p) > chunks.REACH for p in parts[:-1])
    moved = cut("Ünerwartet " + text[:4000] + " inserted words " + text[4000:])
    assert len(set(parts) - set(moved)) < 12
    assert cut("") == [] and cut("kurz") == [b"kurz"] and b"".join(cut("漢" * 500)).decode() == "漢" * 500


def test_shared_passages_are_found_and_removed(spark):
    rng = random.Random(6)
    passages = [prose(rng, 55) for _ in range(6)]
    docs = [(i, prose(rng, 150) + " " + passages[i % 6] + " " + prose(rng, 90)) for i in range(30)]
    clean = [(100 + i, prose(rng, 200)) for i in range(20)]
    odd = [(200, None), (201, ""), (202, "x"), (203, "x"), (None, docs[3][1]), (5, docs[5][1])]
    table = spark.createDataFrame([(i, t, "d", "t", "r", "k") for i, t in docs + clean + odd], EXTRA)
    rows = chunks.span_report(table).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in docs} | {None}
    whole = dict(docs)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            assert whole[r.doc_id][r.span_start : r.span_end] in passages[r.doc_id % 6] and r.is_first == (r.doc_id < 6)
    out = {r.doc_id: r for r in chunks.drop_repeats(table).collect() if r.doc_id is not None}
    assert out[0].asDict() == {"doc_id": 0, "text": whole[0], "doc": "d", "tag": "t", "row": "r", "keep": "k"}
    assert len(out[29].text) < len(whole[29]) - 150 and all(out[i].text == t for i, t in clean)
    assert chunks.span_report(spark.createDataFrame([], DOC)).isEmpty()


def test_passages_without_spaces_are_found(spark):
    rng = random.Random(8)

    def run(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    scripts = ["".join(map(chr, range(0x4E00, 0x5200))), "".join(map(chr, range(0x0E01, 0x0E2F))), "".join(map(chr, range(0x3041, 0x3097))), "abcdefghij0123456789"]
    docs = []
    for letters in scripts:
        shared = run(letters, 400)
        docs += [(len(docs) + i, run(letters, 300) + shared + run(letters, 200)) for i in range(2)]
    rows = chunks.span_report(spark.createDataFrame(docs, DOC)).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in docs}
    for r in rows:
        assert r.n_words >= chunks.MIN_WORDS and 300 <= r.span_start < r.span_end <= 700
    kept = {r.doc_id: r.text for r in chunks.drop_repeats(spark.createDataFrame(docs, DOC)).collect()}
    assert all(len(kept[i]) == 900 if i % 2 == 0 else len(kept[i]) < 700 for i, _ in docs)


def test_words_of_each_script():
    def words(*texts):
        data, offsets = tokens.utf8(pa.array(texts, pa.string()))
        halves = np.concatenate([[0], np.cumsum(chunks.word_halves(data, offsets))])
        return (np.diff(halves[offsets]) / 2).tolist()

    assert words("one two\tthree ", "four", "", " fünf ", "x" * 32, "x" * 60) == [3, 1, 0, 1, 1, 10]
    assert words("漢字" * 10, "漢字 abc", "привет мир", "ภาษาไทย", "") == [10, 2, 2, 3.5, 0]


def test_spans_match_brute_force(spark):
    rng = random.Random(15)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    passages = [some(n) for n in (30, 45, 80, 120)]
    docs = []
    for i in range(40):
        parts = [some(rng.randrange(40)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        docs.append((i, rng.choice([" ", "\n"]).join(parts)))
    docs += [(50, "x " * 450), (51, "x " * 650), (52, None), (53, ""), (None, docs[3][1]), (54, docs[3][1]), docs[4], docs[4], (5, docs[6][1])]
    got = [tuple(r) for r in chunks.span_report(spark.createDataFrame(docs, DOC).repartition(3)).collect()]
    want = brute.spans(docs, chunks._GEAR, chunks.REACH, chunks.WINDOW, chunks.MOST, chunks.MIN_WORDS)
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 25
