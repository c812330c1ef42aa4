"""Icon-to-item links: layers, latest corrections, lookups and reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.hashing import digest_number
from slotvalue.functions.pricing import fallback_price, link_certainty
from slotvalue.functions.text import mentions
from slotvalue.operators.skew import top_per_group
from slotvalue.runtime import checkpoint

# Letters of the runs that names are indexed by.
GRAM = 3
# Queries that are sent to all tasks that read names; of more, both sides are shuffled.
SENT_QUERIES = 50_000
# Later layers win.
AUTO, FLAT, MANUAL = 0, 1, 2


def latest_manual_links(events: DataFrame) -> DataFrame:
    """Newest manual event per icon; newest means the largest ``seq``, not the time stamp."""
    manual = events.where((F.col("source") == "manual") & (F.col("item_id") != ""))
    return top_per_group(manual.select("icon_id", "item_id", "seq"), ["icon_id"], [F.col("seq").desc()], 1).drop("rn")


def project_links(auto: DataFrame, flat: DataFrame, events: DataFrame) -> DataFrame:
    """One link per icon: matcher result, replaced whole by flat overrides, then by events."""
    fields = ["icon_id", "item_id", "score", "margin"]
    no_score = F.lit(None).cast("double")
    layers = [
        auto.where(F.coalesce(F.col("item_id"), F.lit("")) != "").select(
            *fields, F.lit(AUTO).alias("layer")
        ),
        flat.select(
            "icon_id", "item_id", no_score.alias("score"), no_score.alias("margin"), F.lit(FLAT).alias("layer")
        ),
        latest_manual_links(events).select(
            "icon_id", "item_id", no_score.alias("score"), no_score.alias("margin"), F.lit(MANUAL).alias("layer")
        ),
    ]
    stacked = layers[0].unionByName(layers[1]).unionByName(layers[2])
    winner = top_per_group(stacked, ["icon_id"], [F.col("layer").desc()], 1)
    return winner.select(*fields, (F.col("layer") > AUTO).alias("override"))


def with_certainty(links: DataFrame) -> DataFrame:
    return links.withColumn("certainty", link_certainty(F.col("score"), F.col("margin"), F.col("override")))


def effective_map(auto: DataFrame, flat: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inspection view: every icon of the matcher, with flat overrides on top.

    An override that names an unknown item is shown as such instead of being dropped.
    """
    known = catalog.select(
        F.col("item_id").alias("flat_id"),
        F.col("name").alias("flat_name"),
        F.col("short").alias("flat_short"),
        fallback_price(F.col("avg24h"), F.col("low"), F.col("base"), default_zero=False).alias("flat_price"),
    )
    pinned = flat.select("icon_id", F.col("item_id").alias("flat_id")).join(known, "flat_id", "left")
    auto = auto.select("icon_id", "item_id", "name", "short", "price", "score", "margin")
    both = auto.join(pinned, "icon_id", "full_outer")
    fixed = F.col("flat_id").isNotNull()

    def pick(flat_col, auto_col):
        return F.when(fixed, flat_col).otherwise(F.col(auto_col)).alias(auto_col)

    return both.select(
        "icon_id",
        pick(F.col("flat_id"), "item_id"),
        pick(F.coalesce("flat_name", F.lit("(unknown id)")), "name"),
        pick(F.col("flat_short"), "short"),
        pick(F.col("flat_price"), "price"),
        pick(F.lit(None), "score"),
        pick(F.lit(None), "margin"),
        F.when(fixed, "override").otherwise("auto").alias("source"),
    )


def review_rank(mapping: DataFrame) -> DataFrame:
    """Doubt about each mapping: score minus margin, fixed ones far below."""
    doubt = F.coalesce("score", F.lit(0.0)) - F.coalesce("margin", F.lit(0.0))
    return mapping.withColumn("doubt", F.when(F.col("source") == "override", -1e9).otherwise(doubt))


def review(mapping: DataFrame, mode: str, n: int, seed: int = 0) -> DataFrame:
    """First ``n`` mappings to look at: ``worst``, ``best`` or a repeatable ``random`` sample."""
    ranked = review_rank(mapping)
    order = {
        "best": [F.col("doubt").asc(), F.col("icon_id")],
        "random": [digest_number(seed, F.col("icon_id"), digits=15), F.col("icon_id")],
    }.get(mode, [F.col("doubt").desc(), F.col("icon_id")])
    return ranked.orderBy(*order).limit(n)


def find_items(catalog: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Catalog rows whose name contains a typed query, one row per query and item.

    The queries are literals, so the test is a projection of the catalog scan, not a join.
    """
    typed = F.array(*[F.lit(q) for q in dict.fromkeys(queries)])
    hits = F.filter(typed, lambda q: F.contains(F.lower("name"), F.lower(q)))
    return catalog.select("item_id", "name", "pos", F.explode(hits).alias("query"))


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` letters; the empty run for size 0."""
    if not size:
        return F.array(F.lit(""))
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def find_asked(catalog: DataFrame, asked: DataFrame, gram: int = GRAM) -> DataFrame:
    """Catalog rows whose name contains a query of the table ``asked (query)``, one row per query and item.

    An inverted index: every name under each of its runs of ``gram`` letters.  A query is looked up under the rarest of its
    own runs only, and what is found there is tested as a whole.  Queries of fewer letters use runs of their own
    length, so they need no scan either; the empty query is in every name.  The index is never held whole: up to
    ``SENT_QUERIES`` queries go to the names, of more both sides are shuffled by run.
    """
    typed = asked.select("query", F.lower("query").alias("needle")).where(F.col("query").isNotNull()).distinct()
    typed = checkpoint(typed.withColumn("size", F.least(F.length("needle"), F.lit(gram))))
    sizes = [r["size"] for r in typed.select("size").distinct().collect()]
    if not sizes:
        return catalog.select("item_id", "name", "pos", F.lit(None).cast("string").alias("query")).limit(0)
    pick = None
    for size in sizes:
        own = _grams(F.col("needle"), size)
        pick = F.when(F.col("size") == size, own) if pick is None else pick.when(F.col("size") == size, own)
    wanted = typed.select("query", "needle", F.explode(pick).alias("gram"))
    every = F.flatten(F.array(*[_grams(F.lower("name"), size) for size in sizes]))
    postings = catalog.where(F.col("name").isNotNull()).select("item_id", "name", "pos", F.explode(every).alias("gram"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    # A run that no name has is the rarest of all: the query finds nothing.
    counted = wanted.join(counts.hint("merge"), "gram", "left")
    rarest = counted.groupBy("query", "needle").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("r"))
    looked = checkpoint(rarest.where(F.col("r.names") > 0).select("query", "needle", F.col("r.gram").alias("gram")))
    # The planner takes the postings for as small as the names they come from, so the side to send is not left to it.
    looked = F.broadcast(looked) if looked.count() <= SENT_QUERIES else looked.hint("merge")
    found = postings.join(looked, "gram").where(F.contains(F.lower("name"), F.col("needle")))
    return found.select("item_id", "name", "pos", "query")


def resolve_unique(catalog: DataFrame, queries: Sequence[str] | DataFrame, listed: int) -> DataFrame:
    """Turn each typed text, an item id or a part of a name, into one item.

    ``queries`` are a few texts or a table ``(query)``.  ``status`` is ``id`` (exact id), ``unique``, ``none`` or
    ``ambiguous``; an ambiguous text comes with its first ``listed`` items in catalog order (``pos``) and the full
    number of hits.
    """
    if isinstance(queries, DataFrame):
        asked = queries.select("query").where(F.col("query").isNotNull()).distinct()
        by_name = find_asked(catalog, asked)
    else:
        asked = catalog.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string")
        by_name = find_items(catalog, queries)
    exact = catalog.join(asked.hint("merge"), F.col("item_id") == F.col("query")).select("query", F.lit(True).alias("is_id"), "item_id", "name")
    hits = by_name.groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    first = top_per_group(by_name, ["query"], [F.col("pos"), F.col("item_id")], listed).select("query", "item_id", "name")
    # ``asked`` has a row per query, the others at most ``listed`` times that: none of them is small.
    open_ = asked.join(exact.select("query").distinct().hint("merge"), "query", "left_anti").join(hits.hint("merge"), "query", "left")
    state = open_.join(first.hint("merge"), "query", "left").select(
        "query",
        F.when(F.col("hits") == 1, "unique").when(F.col("hits") > 1, "ambiguous").otherwise("none").alias("status"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        "item_id",
        "name",
    )
    return state.unionByName(
        exact.select("query", F.lit("id").alias("status"), F.lit(1).cast("bigint").alias("hits"), "item_id", "name")
    )


def search_items(catalog: DataFrame, query: str, limit: int) -> DataFrame:
    """Items whose name or short name contains the text, best first.

    Short-name prefixes come first, then name prefixes, then shorter names, then catalog order.
    """
    needle = " ".join(query.lower().split())
    short, name = F.lower(F.coalesce("short", F.lit(""))), F.lower("name")
    hits = catalog.where(mentions(F.lit(needle), F.col("name"), F.col("short")))
    order = [~F.startswith(short, F.lit(needle)), ~F.startswith(name, F.lit(needle)), F.length("name"), F.col("pos"), F.col("item_id")]
    return hits.orderBy(*order).limit(limit)
