"""Resolve recognised text to catalog items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotvalue.functions.geometry import in_top_strip
from slotvalue.functions.rounding import round_share
from slotvalue.functions.similarity import ratios
from slotvalue.functions.text import normalise
from slotvalue.operators.skew import present_key, spread_missing, top_per_group
from slotvalue.runtime import checkpoint

# Fixed value: lowest similarity that counts as a match.
CUTOFF = 0.6
# Name lengths that share a join key.
LENGTHS = 4
# Candidates of each text that are scored before the others are held against the best of them.
SEEDS = 4


def name_index(catalog: DataFrame, column: str, position: str = "pos") -> DataFrame:
    """Lower-cased name to item; the first of equal names wins, empty names are skipped."""
    named = catalog.where(F.col(column) != "").withColumn("key", F.lower(column))
    return named.groupBy("key").agg(F.min_by("item_id", position).alias("item_id"))


@F.pandas_udf(T.DoubleType())
def _ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Matching-block ratio of each pair."""
    return pd.Series(ratios(first, second), dtype="float64")


def _letter_tokens(text: str) -> Column:
    """``(letter, occurrence)`` of every letter of a text: what two texts share of it is a plain set intersection."""
    whole, starts = F.col(text), F.sequence(F.lit(1), F.length(text))
    letters = F.array_distinct(F.transform(starts, lambda i: F.substr(whole, i, F.lit(1))))

    def occurrences(c):
        times = F.length(whole) - F.length(F.replace(whole, c, F.lit("")))
        code = F.shiftleft(F.ascii(c).cast("bigint"), 32)
        return F.transform(F.sequence(F.lit(1), times), lambda n: code + n)

    return F.flatten(F.transform(letters, occurrences))


def _token_counts(index: DataFrame) -> DataFrame:
    """In how many names each token occurs."""
    return index.select(F.explode(_letter_tokens("key")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("names"))


def _ranked_tokens(df: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """``(text, ranked)``: the tokens of each text, those of the fewest names first."""
    tokens = df.select(text, F.explode(_letter_tokens(text)).alias("token")).join(counts, "token", "left")
    placed = F.array_sort(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "token")))
    return tokens.groupBy(text).agg(placed["token"].alias("ranked"))


def ratio_candidates(texts: DataFrame, index: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``(text, key, bound)``: every pair whose shared letters allow a ratio of ``cutoff``, once.

    The ratio is twice the matched letters over both lengths ``a`` and ``b``, and the matched letters are among
    the shared (letter, occurrence) tokens: a pair needs ``need = ceil(cutoff * (a + b) / 2)`` of them.  With the
    tokens of both sides in one order, rare ones first, the first shared one is at a place ``i`` with
    ``a - i >= need`` and ``b - j >= need``.  So a token at place ``i`` only meets names up to a length that falls with
    ``i``; the join key is the token and a range of ``LENGTHS`` lengths, and a pair is kept at its first shared token.
    No pair at the cutoff is lost, and short texts need no case of their own.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be above 0 and at most 1")
    asked = texts.where(F.col("text") != "").select("text").distinct()
    counts = _token_counts(index)
    a, b, i, j = (F.col(c) for c in "abij")
    need = lambda x, y: F.ceil((x + y) * (cutoff / 2) - 1e-9)
    least = lambda x: F.ceil(x * (cutoff / (2 - cutoff)) - 1e-9)
    most = F.floor((a - i) * (2 / cutoff) + 1e-9) - a

    def placed(df, text, length, place, ranked):
        rows = _ranked_tokens(df, text, counts).withColumn(length, F.size("ranked"))
        return rows.select(text, F.col("ranked").alias(ranked), length, F.posexplode("ranked").alias(place, "token"))

    left = placed(asked, "text", "a", "i", "t_ranked").where(a - i >= need(a, least(a)))
    spread = F.explode(F.sequence(F.floor(least(a) / LENGTHS), F.floor(most / LENGTHS)))
    left = left.where(most >= least(a)).withColumn("lengths", spread)
    right = placed(index.select("key"), "key", "b", "j", "n_ranked").where(b - j >= need(b, least(b)))
    met = left.join(right.withColumn("lengths", F.floor(b / LENGTHS)), ["token", "lengths"])
    met = met.where(F.least(a - i, b - j) >= need(a, b)).withColumn("shared", F.array_intersect("t_ranked", "n_ranked"))
    met = met.where((F.get("shared", F.lit(0)) == F.col("token")) & (F.size("shared") >= need(a, b)))
    return met.select("text", "key", (F.size("shared") * 2.0 / (a + b)).alias("bound"))


def fuzzy_best(texts: DataFrame, index: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Best fuzzy name per distinct text (column ``text``).

    Candidates are written once.  The ``SEEDS`` with the highest bounds of each text are scored first; of the others only
    those whose bound reaches the best score so far can still win or tie.  Names are compared as the first
    sequence; of equal ratios the last name in alphabetical order wins.
    """
    order = W.partitionBy("text").orderBy(F.col("bound").desc(), F.col("key").desc())
    found = checkpoint(ratio_candidates(texts, index, cutoff).withColumn("place", F.row_number().over(order)))
    scored = lambda df: df.select("text", F.struct(_ratio("key", "text").alias("score"), "key").alias("hit"))
    top = lambda df: df.groupBy("text").agg(F.max("hit").alias("hit"))
    seeds = checkpoint(top(scored(found.where(F.col("place") <= SEEDS))))
    rest = found.where(F.col("place") > SEEDS).join(seeds, "text").where(F.col("bound") >= F.greatest("hit.score", F.lit(cutoff)))
    best = top(seeds.unionByName(scored(rest.select("text", "key"))))
    return best.where(F.col("hit.score") >= cutoff).select("text", F.col("hit.key").alias("key"))


def _prefixes(df: DataFrame, text: str, counts: DataFrame, cutoff: float) -> DataFrame:
    """``(text, prefix)``: the rarest tokens of each text, as many as cannot all be absent from a match."""
    needed = F.length(text) - F.ceil(cutoff * F.length(text) - 1e-9) + 1
    return _ranked_tokens(df, text, counts).select(text, F.slice("ranked", F.lit(1), needed.cast("int")).alias("prefix"))


def levenshtein_best(texts: DataFrame, index: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Best name per distinct text by edit distance, without Python: ``(text, key, item_id, score)``.

    The score is one less the distance over the longer length; ``cutoff`` is above 0.  An edit changes
    at most one letter on either side, so a pair at the cutoff shares at least ``cutoff`` times the longer
    length of its (letter, occurrence) tokens, in any order.  Sorted by rarity among the names, the
    tokens of a text that come after its first ``length - ceil(cutoff * length)`` are too few for that, and one
    more is the prefix that every match of it meets: the join on prefixes of both sides loses no pair.  A pair is
    scored at its first shared token if its lengths are admissible.  Of equal scores the last name in
    alphabetical order wins.
    """
    if cutoff <= 0:
        raise ValueError("cutoff must be above 0")
    asked = texts.where(F.col("text") != "").select("text").distinct()
    counts = _token_counts(index)
    offered = _prefixes(index.select("key"), "key", counts, cutoff).withColumnRenamed("prefix", "n_prefix")
    asked = _prefixes(asked, "text", counts, cutoff).withColumnRenamed("prefix", "t_prefix")
    met = asked.withColumn("token", F.explode("t_prefix")).join(offered.withColumn("token", F.explode("n_prefix")), "token")
    longer, shorter = F.greatest(F.length("text"), F.length("key")), F.least(F.length("text"), F.length("key"))
    first = F.array_intersect("t_prefix", "n_prefix")[0] == F.col("token")
    met = met.where((shorter >= cutoff * longer - 1e-9) & first)
    scored = met.withColumn("score", 1 - F.levenshtein("text", "key") / longer).where(F.col("score") >= cutoff)
    best = top_per_group(scored, ["text"], [F.col("score").desc(), F.col("key").desc()], 1)
    return best.join(index.select("key", "item_id"), "key").select("text", "key", "item_id", "score")


def match_names(texts: DataFrame, catalog: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Item and score for each distinct ``text`` (already normalised).

    Stages: exact short name, exact full name, best fuzzy short name, best fuzzy full name.
    A later stage only sees the texts the earlier ones left over; the results of a stage are
    written once, as the next one reads them several times.  Texts without a match have a
    null item and score 0.
    """
    texts = texts.where(F.col("text") != "").select("text").distinct()
    short, full = name_index(catalog, "short"), name_index(catalog, "name")
    exact = checkpoint(exact_names(texts, short, full))
    open_texts = exact.where(F.col("item_id").isNull()).select("text")
    by_short = checkpoint(fuzzy_best(open_texts, short, cutoff).join(short, "key"))
    left = open_texts.join(by_short.select("text"), "text", "left_anti")
    by_full = fuzzy_best(left, full, cutoff).join(full, "key")
    fuzzy = by_short.withColumn("stage", F.lit("fuzzy_short")).unionByName(
        by_full.withColumn("stage", F.lit("fuzzy_full"))
    )
    fuzzy = fuzzy.select(
        "text", F.col("item_id").alias("f_item"), F.col("stage").alias("f_stage"), _ratio("text", "key").alias("f_score")
    )
    merged = exact.join(fuzzy, "text", "left")
    return merged.select(
        "text",
        F.coalesce("item_id", "f_item").alias("item_id"),
        F.coalesce("stage", "f_stage").alias("stage"),
        F.when(F.col("item_id").isNotNull(), 1.0).otherwise(F.coalesce("f_score", F.lit(0.0))).alias("score"),
    )


def exact_names(texts: DataFrame, short: DataFrame, full: DataFrame) -> DataFrame:
    """Exact stages only: short name before full name."""
    by_short = short.select(F.col("key").alias("text"), F.col("item_id").alias("short_item"))
    by_full = full.select(F.col("key").alias("text"), F.col("item_id").alias("full_item"))
    found = texts.join(by_short, "text", "left").join(by_full, "text", "left")
    return found.select(
        "text",
        F.coalesce("short_item", "full_item").alias("item_id"),
        F.when(F.col("short_item").isNotNull(), "short").when(F.col("full_item").isNotNull(), "full").alias("stage"),
    )


def assemble_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of each box: words of the top strip by x, all words by x, all in reading order.

    ``words``: keys, ``word_idx, text, x, y, w, h, box_height``.  The result is one text per
    box, so only the words of a single box come together.
    """
    top = in_top_strip(F.col("y"), F.col("h"), F.col("box_height"))
    placed = F.struct("x", "word_idx", "text", top.alias("top"))
    # Collected once; the three texts are the same words in two orders.
    boxes = words.groupBy(*keys).agg(F.array_sort(F.collect_list(placed)).alias("w"))

    def line(col):
        return F.array_join(F.transform(col, lambda w: w["text"]), " ")

    read = F.array_sort(F.transform("w", lambda w: F.struct(w["word_idx"].alias("word_idx"), w["text"].alias("text"))))
    return boxes.select(
        *keys,
        line(F.filter("w", lambda w: w["top"])).alias("top_text"),
        line(F.col("w")).alias("all_text"),
        line(read).alias("raw_text"),
    )


def identify_boxes(words: DataFrame, catalog: DataFrame, keys: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """Item of each box from the words on it.

    The top strip is tried first, then all words; a match counts if its reported score
    reaches the cutoff.  Without one the raw words are kept.
    """
    boxes = assemble_text(words, keys)
    boxes = boxes.withColumn("top_key", normalise(F.col("top_text"))).withColumn(
        "all_key", normalise(F.col("all_text"))
    )
    texts = boxes.select(F.explode(F.array_distinct(F.array("top_key", "all_key"))).alias("text"))
    matched = match_names(texts, catalog, cutoff).where(
        F.col("item_id").isNotNull() & (F.col("score") >= cutoff)
    )

    # Boxes without text share the empty key; they are spread over the joins.
    def side(name):
        return matched.select(
            F.col("text").alias(f"{name}_key"), present_key(F.col("text")).alias(f"{name}_salt"),
            F.col("item_id").alias(f"{name}_item"), F.col("score").alias(f"{name}_score"),
        )

    found = boxes
    for name in ("top", "all"):
        found = found.withColumn(f"{name}_salt", spread_missing(F.col(f"{name}_key"), *[F.col(k) for k in keys]))
        found = found.join(side(name), [f"{name}_key", f"{name}_salt"], "left")
    by_top, by_all = F.col("top_item").isNotNull(), F.col("all_item").isNotNull()
    return found.select(
        *keys,
        F.coalesce("top_item", "all_item", F.lit("")).alias("ocr_id"),
        round_share(F.when(by_top, F.col("top_score")).when(by_all, F.col("all_score")).otherwise(0.0), 2).alias("ocr_score"),
        F.when(by_top, F.col("top_text")).when(by_all, F.col("all_text")).otherwise(F.col("raw_text")).alias("ocr_raw"),
    )
