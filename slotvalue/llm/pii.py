"""Personal data by candidate generation, boosted trees and calibrated thresholds; DataFrame functions only.

Base spans come from four strict patterns with checks (see ``BASE``) and always stay.  Wider patterns (``WIDE``)
propose further, overlapping candidates: separators, groupings and spellings that the strict ones do not take, and
parts of stretches that a strict pattern swallowed whole and its check then refused.

The trees learn from the corpus itself.  A candidate that equals a base span is a positive, one that touches no base
match a negative.  Every positive also gives negatives whose text is spoilt (``_spoilt``), and positives written in
other ways (``_reworded``); candidates that overlap a base match otherwise stay out of the fit.  Features (``features``) describe the format of the span and what
stands around it; the ``+`` of a telephone number is none, so that the rest of the format has to tell.  Boosting
runs on counts per combination of features: a level of a tree is one grouped sum of gradients per (leaf, feature, value),
and the driver sees only those sums.  Trees are symmetric: one split per level.  A fifth of the documents is kept
from the fit and calibrates, for each kind, the lowest score whose precision there reaches ``PRECISION``.

Candidates over the threshold that touch no base span are added; of overlapping ones the higher score wins.

Everything about a document is computed within its row, so nothing but counts is shuffled; only the labels of documents
with more than ``ROW_CANDIDATES`` candidates come from a join.  A text is cut at its
matches once per pattern; patterns start only where a stretch of their characters starts, so that they take time
linear in the text.

Nulls, empty texts and repeated rows: a null or empty text has no spans; a null id stays null; every row is judged
on its own.  Other columns pass through in the struct ``row``.  Where no kind has the positives to calibrate
on, nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.arrow import packed
from slotvalue.runtime import scratch_path

KINDS = ("email", "ip", "card", "phone")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_DOT = r"(?:\.|\[\.\]|\(\.\)| ?\[dot\] ?| ?\(dot\) ?)"
# A pattern may start in the middle of its characters only where the match before has ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:@| ?\(at\) ?| ?\[at\] ?| at )[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}| dot )[A-Za-z0-9-]{{1,63}}){{1,9}}+(?![A-Za-z0-9@])",
    "ip": rf"(?<![0-9]){_OCTET}(?:{_DOT}{_OCTET}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ ._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ ._/-])[0-9]{6}\2[0-9]{4,5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?(?:[0-9]{1,3}[ ./-]?)?(?:\([0-9]{1,4}\)|[0-9]{2,4})[ ./-]?[0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9])",
}
# What a text must hold before a pattern is tried.
_GUARD = {"email": r"@|[(\[]at[)\]]| at ", "ip": r"[0-9](?:\.|\[|\(| )", "card": "[0-9]{4}|[0-9][ -][0-9]", "phone": "[0-9]{2}"}
# Words in front of personal data: mail, telephone, payment and network terms in four languages.
CUES = (
    "e-?mail|contact|kontakt|correo|courriel|write to|schreib",
    "phone|tel[.:]|telefon|tél|call|mobile|handy|llam|appel|fax",
    "card|karte|carte|tarjeta|visa|mastercard|amex|iban|pay",
    "address|adress|adresse|host|server|ip[ :]|direcci|login",
)

# The largest value of a feature; larger ones count as it.
TOP = 40
FEATURES = 18
CONTEXT = 40
# Documents with more candidates get their labels for the fit by a join, in cells of so many code points.
ROW_CANDIDATES = 256
_CELL = 64
TREES, DEPTH, RATE, RIDGE = 10, 3, 0.5, 1.0
PRECISION = 0.9
_MARK, _OTHER = "\x01", "\x02"
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever the body uses it."""
    return F.transform(F.array(value), body)[0]


# --- spans of patterns -----------------------------------------------------------------


def running_starts(sizes: Column) -> Column:
    """Sum of all sizes before each one; in blocks, since appending to a long array copies it."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def sums(values: Column) -> Column:
        return F.aggregate(values, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK)), lambda b: sums(F.slice(sizes, (b * _BLOCK + 1).cast("int"), F.lit(_BLOCK))))
    shifted = lambda found: F.zip_with(found, sums(F.transform(found, lambda b: b["at"]))["starts"], lambda b, at: F.transform(b["starts"], lambda s: s + at))
    return F.flatten(let(blocks, shifted))


def matches(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Matches with their code points, and up to ``CONTEXT`` characters between them and their neighbours.

    ``text`` must not hold ``_MARK``.
    """
    even, odd = (lambda _, i: i % 2 == 0), (lambda _, i: i % 2 == 1)

    def spans(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.length(p).cast("bigint"))
        return let(F.filter(parts, even), lambda gaps: let(F.filter(parts, odd), lambda found: let(F.filter(let(sizes, running_starts), odd), lambda starts: F.transform(found, lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"),
            m.alias("text"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right"),
        )))))

    cut = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    guarded = F.when(text.rlike(_GUARD[kind]) if not (base and kind == "phone") else F.contains(text, F.lit("+")), let(cut, spans))
    return F.coalesce(guarded, F.array().cast(SPANS))


SPANS = "array<struct<kind:int,base:boolean,start:bigint,end:bigint,text:string,left:string,right:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes(kind: Column, text: Column) -> Column:
    """The checks of base matches."""
    n = F.length(_digits(text))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, text.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"))
        .when(kind == 2, n.between(14, 19) & F.call_function("luhn_check", _digits(text)))
        .otherwise(n.between(10, 15))
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(row, tried, wide)``: base matches with ``ok`` where they pass their check, and wide matches."""
    masked = packed(docs, masked=F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, _OTHER))
    tried = F.concat(*[matches(F.col("masked"), k, BASE[k], True) for k in KINDS])
    wide = F.concat(*[matches(F.col("masked"), k, WIDE[k], False) for k in KINDS])
    found = masked.select("row", tried.alias("tried"), wide.alias("wide"))
    ok = F.transform("tried", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), passes(c["kind"], c["text"]).alias("ok")))
    return found.select("row", ok.alias("tried"), "wide")


# --- features --------------------------------------------------------------------------


def _class(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"\s"), 0).when(char.rlike(r"[0-9]"), 3).when(char.rlike(r"[A-Za-z\x80-\x{10FFFF}]"), 2).otherwise(1)


def features(text: Column, left: Column, right: Column) -> Column:
    """Small whole numbers that describe a span and what stands around it."""

    def described(groups: Column) -> Column:
        digits = F.array_join(groups, "")
        return let(digits, lambda d: F.array(
            F.length(d),
            F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
            F.size(groups),
            F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
            F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
            F.length(text) - F.length(d),
            F.coalesce(F.call_function("luhn_check", d), F.lit(False)).cast("int"),
            ((F.size(groups) == 4) & F.forall(groups, lambda g: (F.length(g) <= 3) & (F.lpad(g, 3, "0") <= "255"))).cast("int"),
            F.contains(text, F.lit("(")).cast("int"),
            F.contains(text, F.lit("@")).cast("int"),
            F.length(F.regexp_extract(text, r"(?:\.|dot[\])]? ?)([A-Za-z]+)$", 1)),
            F.length(text) - F.length(F.replace(text, F.lit("."))),
            _class(F.right(left, F.lit(1))),
            _class(F.left(right, F.lit(1))),
            sum((F.when(F.lower(left).rlike(c), i + 1).otherwise(0) for i, c in enumerate(CUES)), F.lit(0)),
            F.length(F.array_join(F.array_distinct(F.split(d, "")), "")),
            right.rlike("^[ .-]?[0-9]").cast("int"),
            left.rlike("[0-9][ .-]?$").cast("int"),
        ))

    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    return F.transform(let(groups, described), lambda v: F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(TOP)))


def _spoilt(kind: Column, text: Column) -> Column:
    """Texts of the same look that are no personal data: no domain, octets too large, wrong check digit, too short or bare."""
    last = F.translate(F.right(text, F.lit(1)), "0123456789", "5678901234")
    return (
        F.when(kind == 0, F.array(F.regexp_replace(text, r"\.(?=[^.]*$)", "-")))
        .when(kind == 1, F.array(F.concat(F.lit("99"), text)))
        .when(kind == 2, F.array(F.concat(F.left(text, F.length(text) - 1), last)))
        .otherwise(F.array(F.left(text, F.length(text) - 5), F.right(_digits(text), F.lit(10))))
    )


def _reworded(kind: Column, text: Column) -> Column:
    """Other common ways to write the same data, which strict patterns do not take: telephone numbers without country code."""
    last = F.right(_digits(text), F.lit(10))
    a, b, c = F.substring(last, 1, 3), F.substring(last, 4, 3), F.substring(last, 7, 4)
    ways = F.array(F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat_ws("-", a, b, c), F.concat_ws(".", a, b, c))
    return F.when((kind == 3) & (F.length(last) == 10), ways).otherwise(F.array().cast("array<string>"))


# --- trees -----------------------------------------------------------------------------


@dataclass
class Model:
    """Trees as (features, thresholds, leaf values), and the lowest score to act on, per kind."""

    trees: list[list[tuple[list[int], list[int], list[float]]]] = field(default_factory=lambda: [[] for _ in KINDS])
    least: list[float] = field(default_factory=lambda: [math.inf for _ in KINDS])

    def score(self, kind: Column, x: Column) -> Column:
        """Sum of the leaf values that the features ``x`` reach."""
        empty = F.array().cast("array<struct<f:array<int>,t:array<int>,v:array<double>>>")

        def literal(trees):
            return F.array(*[F.struct(F.lit(f).cast("array<int>").alias("f"), F.lit(t).cast("array<int>").alias("t"), F.array(*map(F.lit, v)).alias("v")) for f, t, v in trees]) if trees else empty

        own = F.get(F.array(*[literal(t) for t in self.trees]), kind)
        leaf = lambda t: sum((F.when(F.get(x, t["f"][d]) >= t["t"][d], 1 << d).otherwise(0) for d in range(DEPTH)), F.lit(0))
        return F.aggregate(own, F.lit(0.0), lambda s, t: s + F.get(t["v"], leaf(t)))

    def threshold(self, kind: Column) -> Column:
        return F.get(F.array(*[F.lit(float(x)) for x in self.least]), kind)


def _labelled(found: DataFrame) -> DataFrame:
    """``(held, c, y)``: wide candidates, ``y`` 1 if they equal a base span, 0 if they touch no base match; within the row."""
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    equal = lambda a, b: (a["kind"] == b["kind"]) & (a["start"] == b["start"]) & (a["end"] == b["end"]) & b["ok"]
    label = lambda c: F.when(F.exists("tried", lambda b: equal(c, b)), 1).when(F.exists("tried", lambda b: touch(c, b)), None).otherwise(0)
    return found.select("held", F.explode(F.transform("wide", lambda c: F.struct(c.alias("c"), label(c).alias("y")))).alias("e")).select("held", "e.*")


def _labelled_by_join(found: DataFrame) -> DataFrame:
    """The same labels for rows of many candidates: spans meet in the ``_CELL`` code points that both lie in."""
    cells = lambda c: F.explode(F.sequence(F.floor(c["start"] / _CELL), F.floor((c["end"] - 1) / _CELL)))
    numbered = found.select("held", F.monotonically_increasing_id().alias("doc"), "wide", "tried")
    path = scratch_path(found.sparkSession, "pii-long")
    numbered.write.parquet(path)
    numbered = found.sparkSession.read.schema(numbered.schema).parquet(path)
    wide = numbered.select("doc", "held", F.posexplode("wide").alias("place", "c"))
    tried = numbered.select("doc", F.explode("tried").alias("b")).select("doc", cells(F.col("b")).alias("cell"), "b")
    met = wide.select("doc", "place", "c.kind", "c.start", "c.end", cells(F.col("c")).alias("cell")).join(tried.hint("merge"), ["doc", "cell"])
    met = met.where((F.col("start") < F.col("b.end")) & (F.col("b.start") < F.col("end")))
    same = F.coalesce("b.ok", F.lit(False)) & (F.col("kind") == F.col("b.kind")) & (F.col("start") == F.col("b.start")) & (F.col("end") == F.col("b.end"))
    hits = met.groupBy("doc", "place").agg(F.max(same).alias("same"))
    y = F.when(F.col("same").isNull(), 0).when(F.col("same"), 1)
    return wide.join(hits.hint("merge"), ["doc", "place"], "left").select("held", "c", y.alias("y"))


def examples(found: DataFrame, doc_id: str) -> DataFrame:
    """``(kind, held, x, y, n)``: how often each combination of features was positive (``y`` 1) or negative.

    Labels within the row take candidates times base matches; rows with more than ``ROW_CANDIDATES`` get them by a join.
    """
    held = (F.crc32(F.coalesce(F.col(f"row.{doc_id}").cast("string"), F.lit(""))) % 5 == 0).alias("held")
    usable = found.where(F.size("wide") > 0).select(held, "tried", "wide")
    few = F.size("wide") + F.size("tried") <= ROW_CANDIDATES
    rows = _labelled(usable.where(few)).unionByName(_labelled_by_join(usable.where(~few)))
    rows = rows.select("held", "c.*", "y").where(F.col("y").isNotNull())
    made = lambda t, y: F.struct(t.alias("text"), F.lit(y).alias("y"))
    reworded = F.transform(_reworded(F.col("kind"), F.col("text")), lambda t: made(t, 1))
    spoilt = F.transform(_spoilt(F.col("kind"), F.col("text")), lambda t: made(t, 0))
    own = F.array(F.struct("text", "y"))
    both = F.when(F.col("y") == 1, F.concat(own, spoilt, reworded)).otherwise(own)
    rows = rows.select("held", "kind", "left", "right", F.explode(both).alias("e"))
    x = features(F.col("e.text"), F.col("left"), F.col("right"))
    return rows.select("kind", "held", x.alias("x"), F.col("e.y").alias("y")).groupBy("kind", "held", "x", "y").agg(F.count("*").alias("n"))


def _best_split(sums: dict[tuple[int, int, int], tuple[float, float]], leaves: int) -> tuple[int, int, list[float]]:
    """Feature, threshold and values of the two halves of every leaf with the largest total gain."""
    best = None
    for feature in sorted({f for _, f, _ in sums}):
        values = sorted({v for _, f, v in sums if f == feature})
        for threshold in values[1:] or values:
            halves = [[0.0, 0.0] for _ in range(2 * leaves)]
            for value in values:
                for leaf in range(leaves):
                    g, h = sums.get((leaf, feature, value), (0.0, 0.0))
                    half = halves[leaf + leaves * (value >= threshold)]
                    half[0] += g
                    half[1] += h
            gain = float(f"{sum(g * g / (h + RIDGE) for g, h in halves):.9g}")
            if best is None or gain > best[0]:
                best = (gain, feature, threshold, [round(RATE * g / (h + RIDGE), 6) for g, h in halves])
    return best[1:]


def fit(cells: DataFrame) -> Model:
    """Boosted trees per kind from the cells of ``examples``; one grouped sum for each level of a round."""
    model = Model()
    y, n = F.col("y"), F.col("n")
    fitted = cells.where(~F.col("held"))
    both = fitted.groupBy("kind").agg(F.count_distinct("y").alias("labels")).where(F.col("labels") == 2)
    kinds = sorted(r["kind"] for r in both.collect())
    if not kinds:
        return model
    fitted = fitted.where(F.col("kind").isin(kinds))
    for _ in range(TREES):
        p = F.lit(1.0) / (1 + F.exp(-model.score(F.col("kind"), F.col("x"))))
        slope = (n * (y - F.col("p"))).alias("g"), (n * F.col("p") * (1 - F.col("p"))).alias("h")
        scored = fitted.withColumn("p", p).select("kind", "x", *slope)
        splits: dict[int, tuple[list[int], list[int]]] = {k: ([], []) for k in kinds}
        values: dict[int, list[float]] = {}
        for depth in range(DEPTH):
            leaf = F.lit(0)
            for d in range(depth):
                f = F.get(F.array(*[F.lit(splits[k][0][d] if k in splits else 0) for k in range(len(KINDS))]), F.col("kind"))
                t = F.get(F.array(*[F.lit(splits[k][1][d] if k in splits else 0) for k in range(len(KINDS))]), F.col("kind"))
                leaf = leaf + F.when(F.get("x", f) >= t, 1 << d).otherwise(0)
            rows = scored.select("kind", leaf.alias("leaf"), "g", "h", F.posexplode("x").alias("feature", "value"))
            sums: dict[int, dict] = {k: {} for k in kinds}
            for r in rows.groupBy("kind", "leaf", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums[r["kind"]][r["leaf"], r["feature"], r["value"]] = (r["g"], r["h"])
            for k in kinds:
                feature, threshold, values[k] = _best_split(sums[k], 1 << depth)
                splits[k][0].append(feature)
                splits[k][1].append(threshold)
        for k in kinds:
            model.trees[k].append((*splits[k], values[k]))
    return model


def calibrate(model: Model, cells: DataFrame) -> Model:
    """The lowest score of each kind whose smoothed precision in the held-out documents is high enough."""
    score = F.round(model.score(F.col("kind"), F.col("x")), 2).alias("score")
    counts = cells.where("held").select("kind", score, "y", "n").groupBy("kind", "score").agg(F.sum(F.col("n") * F.col("y")).alias("hits"), F.sum("n").alias("n"))
    rows = sorted(((r["kind"], -r["score"], r["hits"], r["n"]) for r in counts.collect()), key=lambda r: r[:2])
    seen: dict[int, list[int]] = {}
    for kind, minus, hits, n in rows:
        total = seen.setdefault(kind, [0, 0])
        total[0] += hits
        total[1] += n
        if model.trees[kind] and hits and (total[0] + 1) / (total[1] + 2) >= PRECISION:
            model.least[kind] = -minus - 0.005
    return model


def train(found: DataFrame, doc_id: str = "doc_id") -> Model:
    """A calibrated model from ``candidates``, which should be a written table."""
    path = scratch_path(found.sparkSession, "pii-cells")
    examples(found, doc_id).write.parquet(path)
    cells = found.sparkSession.read.parquet(path)
    return calibrate(fit(cells), cells)


# --- selection -------------------------------------------------------------------------

ADDED = "array<struct<kind:int,start:bigint,end:bigint,score:double>>"


def _chosen(tried: Column, wide: Column, model: Model) -> Column:
    """Wide candidates over their threshold that touch no base span; of overlapping ones the best."""
    shape = lambda c, base, score: F.struct(c["start"].alias("start"), (~base).cast("int").alias("wide"), c["end"].alias("end"), c["kind"].alias("kind"), score.alias("score"))
    base = F.transform(F.filter(tried, lambda b: b["ok"]), lambda b: shape(b, F.lit(True), F.lit(0.0)))
    scored = F.transform(wide, lambda c: shape(c, F.lit(False), model.score(c["kind"], features(c["text"], c["left"], c["right"]))))
    scored = F.filter(scored, lambda c: c["score"] >= model.threshold(c["kind"]))
    one = "struct<start:bigint,wide:int,end:bigint,kind:int,score:double>"
    zero = F.struct(F.array().cast(f"array<{one}>").alias("out"), F.lit(None).cast(one).alias("last"), F.lit(0).cast("bigint").alias("base_end"))
    state = lambda out, last, end: F.struct(out.alias("out"), last.alias("last"), end.alias("base_end"))

    def step(s: Column, c: Column) -> Column:
        last, apart = s["last"], s["last"].isNull() | (s["last"]["end"] <= c["start"])
        gone = F.lit(None).cast(one)
        return (
            F.when(c["wide"] == 0, state(s["out"], F.when(apart, last).otherwise(gone), F.greatest(s["base_end"], c["end"])))
            .when(c["start"] < s["base_end"], s)
            .when(last.isNull(), state(s["out"], c, s["base_end"]))
            .when(apart, state(F.concat(s["out"], F.array(last)), c, s["base_end"]))
            .when(c["score"] > last["score"], state(s["out"], c, s["base_end"]))
            .otherwise(s)
        )

    finish = lambda s: F.when(s["last"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["last"])))
    # Rows without a candidate over the threshold need no walk.
    walked = lambda some: F.when(F.size(some) > 0, F.aggregate(F.array_sort(F.concat(base, some)), zero, step, finish))
    fields = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score"))
    return F.coalesce(F.transform(let(scored, walked), fields), F.array().cast(ADDED))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``(row, base, added)``: base spans and added spans of every row, by start.

    Without a model one is trained on ``docs``.  The candidates are written once and read by the fit and the selection.
    """
    path = scratch_path(docs.sparkSession, "pii")
    candidates(docs, text).write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    model = model or train(found, doc_id)
    base = F.transform(F.filter("tried", lambda b: b["ok"]), lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return found.select("row", base.alias("base"), _chosen(F.col("tried"), F.col("wide"), model).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start and kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or chain of overlapping ones, replaced by its first kind in brackets; null if it is null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        piece = F.substring(text, (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int"))
        new = F.struct(c["end"].alias("at"), F.concat(s["out"], F.array(piece, F.get(names, c["kind"]))).alias("out"))
        return F.when(c["start"] >= s["at"], new).otherwise(F.struct(F.greatest(s["at"], c["end"]).alias("at"), s["out"].alias("out")))

    rest = lambda s: F.concat(s["out"], F.array(F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(text.isNotNull(), F.array_join(F.aggregate(ordered, zero, step, rest), ""))


def span_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: Model | None = None) -> DataFrame:
    """Per row: base spans by kind, their digest, all spans, and how many were added."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    path = scratch_path(docs.sparkSession, "pii")
    found = candidates(slim).withColumn("row", F.struct("row.doc_id"))
    found.write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    model = model or train(found)
    base = F.transform(F.filter("tried", lambda b: b["ok"]), lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    out = found.select("row.doc_id", base.alias("base"), _chosen(F.col("tried"), F.col("wide"), model).alias("added"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", plain)).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )
