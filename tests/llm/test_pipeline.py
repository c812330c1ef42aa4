"""The pipeline, stage by stage, against plain Python on a small set."""

import corpus_pipeline
from slotvalue.llm import toxicity
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()))


def test_stages_match_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns = docs.columns

    scores = toxicity.score_documents(docs, toxicity.train(docs, labels))
    kept = stages["toxicity"](spark, docs, DATA)
    assert {r["doc_id"] for r in scores.where("predicted = 0").collect()} == {i for i, _ in rows_of(kept)} and kept.columns == columns

    out = stages["line_dedup"](spark, kept, DATA)
    assert rows_of(out) == sorted((i, t) for i, _, _, t in brute.dedup_lines(rows_of(kept)))
    assert out.columns == columns and all(r["n_chars"] == len(r["text"]) for r in out.collect())

    before = rows_of(out)
    out = stages["jaccard_join"](spark, out, DATA)
    found = brute.classes(before)
    assert rows_of(out) == [d for d in before if found[d][0] == d[0]] and out.columns == columns

    before = rows_of(out)
    out = stages["decontamination"](spark, out, DATA)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = {d for d, *_ in brute.contained(before, items)}
    assert rows_of(out) == [d for d in before if d[0] not in hit] and out.columns == columns

    texts = dict(rows_of(out))
    mixed = stages["source_mixing"](spark, out, DATA).collect()
    taken, target = {}, {}
    for r in mixed:
        assert r["text"] == texts[r["doc_id"]] and 1 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 5 for s in target)

    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed))


ODD = "doc_id bigint, text string, lang string, source string, n_chars int"


def odd_documents():
    line = "a line of well over forty characters that many documents hold"
    docs = [(i, f"{line}\nown words of number {i} and some more of them {i * 7}", "en", "s1" if i % 2 else None, 90) for i in range(12)]
    docs += [(100, None, None, "s2", None), (101, "", "en", "s2", 0), (None, "text without a number " * 9, "en", "s1", 190), (102, "wörd " * 40_000, "de", "s1", 200_000)]
    return [*docs, docs[0], docs[0], (3, "another text under a known number", None, "s3", 33)]


def through(spark, docs):
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        kept.append(docs)
    return kept


def test_odd_documents_pass_every_stage(spark):
    docs = spark.createDataFrame(odd_documents(), ODD).repartition(3)
    *stages, mixed = through(spark, docs)
    assert all(s.columns == docs.columns for s in stages)
    ids = [r["doc_id"] for r in stages[0].collect()]
    assert len(ids) == len(odd_documents())
    # Lines that five documents hold stay in the last of them.
    texts = {r["doc_id"]: r["text"] for r in stages[1].where("doc_id in (0, 11, 100, 101)").collect()}
    assert "\n" not in texts[0] and "\n" in texts[11] and texts[100] is None and texts[101] == ""
    # Equal rows stay together, and so do texts without words.
    left = sorted(str(r["doc_id"]) for r in stages[2].collect())
    assert left.count("0") == 3 and left.count("3") == 2 and {"100", "101", "None", "102"} <= set(left)
    assert all(1 <= r["copies"] <= 2 for r in mixed.collect())


def test_further_columns_stay_apart(spark):
    names = ["row", "doc", "tag", "keep", "kept", "label", "score", "cell", "bands", "_k", "hash"]
    docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(odd_documents())], ODD + "".join(f", {n} string" for n in names))
    *stages, mixed = through(spark, docs)
    assert all(s.columns == docs.columns for s in stages) and mixed.count() > 0
    assert {r["row"] for r in stages[2].where("doc_id = 102").collect()} == {"row15"}


def test_an_empty_table_passes_every_stage(spark):
    empty = spark.createDataFrame([], ODD)
    assert [s.count() for s in through(spark, empty)] == [0] * 5
