"""Language of web pages by Bayesian fusion of text, markup and address.

* Text: a naive Bayes model of byte trigrams, counted over all labelled documents by grouped aggregation.
  The evidence of a text is its mean log-likelihood times a bounded number of trigrams, since
  neighbouring trigrams are not independent.
* Declared language: the primary tag in the markup, with its reliability P(declared | language).
* Address suffix: P(suffix | language).
* Host: a prior over languages, smoothed from the whole table to the registered domain to the host.

Reliability, suffix and host statistics come from grouped counts of the pages' most likely languages by
text alone.  A page's own count is taken out of the statistics it is judged by.  Counts arrive as one row per key
and task, so a hot host is none; the join that brings them back to pages may be split by adaptive
execution.

Nulls and repeated rows: a page without text, url or markup is judged by what is left, in the end by
the whole table's prior; unknown declared languages are one value, missing ones another; documents
without label or text teach nothing; repeated rows count each.  Without any labelled document there
are no languages and the result has null ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm import tokens
from slotvalue.llm.arrow import batch_of, map_batches
from slotvalue.llm.urls import host_levels, url_parts
from slotvalue.runtime import scratch_path

BUCKETS = 1 << 15
# Trigrams that a text counts for at most, and needs to take part in the statistics.
EVIDENCE, ENOUGH = 40, 20
# Strength of the domain prior of a host and of the whole table's prior of a domain, in pages.
STRENGTH = 8.0
# Smoothing of P(declared | language) and P(suffix | language), in pages.
ALPHA = 0.5

_OPEN = re.compile(rb"[<&]")
_RAW = re.compile(rb"(?i)<(script|style)\b")
_RAW_END = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style")}
_ENTITY = re.compile(rb"(?i)&[a-z0-9#]{1,8};")
_HTML, _META = re.compile(rb"(?i)<html\b"), re.compile(rb"(?i)<meta\b")
_LANG = re.compile(rb"(?i)\slang\s*=\s*[\"']?([a-z]{2,3})\b")
_ABOUT_LANGUAGE = re.compile(rb"(?i)content-language")
_CONTENT = re.compile(rb"(?i)content\s*=\s*[\"']?([a-z]{2,3})\b")

_LETTER = np.full(256, 0x20, np.uint8)
for _b in (*range(ord("a"), ord("z") + 1), *range(128, 256)):
    _LETTER[_b] = _b


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of several texts and the first trigram of each.

    Everything but letters is a blank; trigrams with two blanks at their end or start are left out.
    """
    data, offsets = tokens.utf8(pc.utf8_lower(text))
    d = _LETTER[data].astype(np.uint32)
    n = max(0, len(d) - 2)
    code = (d[:n] << np.uint32(16)) | (d[1 : n + 1] << np.uint32(8)) | d[2:]
    ok = (d[1 : n + 1] != 0x20) | ((d[:n] != 0x20) & (d[2:] != 0x20))
    for back in (1, 2):
        last = offsets[1:] - back
        ok[last[(last >= 0) & (last < n)]] = False
    at = np.flatnonzero(ok)
    bucket = (code[at] * np.uint32(2_654_435_761)) >> np.uint32(32 - 15)
    return bucket, np.searchsorted(at, offsets)


def _count(languages: list[str]):
    place = {name: i for i, name in enumerate(languages)}

    def run(batches, schema):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            text, label = batch.column(0), batch.column(1)
            for a, b in tokens.slices(text):
                own = np.array([place[x] for x in label[a:b].to_pylist()])
                bucket, first = trigrams(text[a:b])
                code = np.repeat(own, np.diff(first)) * BUCKETS + bucket
                total += np.bincount(code, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield batch_of({"lang": lang, "bucket": bucket, "n": total[lang, bucket]}, schema)

    return run


class TextModel:
    """Log-probabilities of trigram buckets, one row per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else np.zeros((0, BUCKETS))

    def evidence(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of several texts (rows) by language, and their trigrams."""
        bucket, first = trigrams(text)
        n = np.diff(first)
        total = np.zeros((len(n), len(self.languages)))
        full = n > 0
        for k in range(len(self.languages)):
            if full.any():
                total[full, k] = np.add.reduceat(self.logs[k][bucket], first[:-1][full])
        return total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None], n


def fit_text(docs: DataFrame, text: str = "text", label: str = "lang") -> TextModel:
    """Counts all labelled documents; the driver gets ``BUCKETS`` numbers per language."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"))
    languages = sorted(r[0] for r in rows.select("label").distinct().collect())
    counts = np.zeros((len(languages), BUCKETS))
    found = map_batches(rows, _count(languages), "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for r in found.toLocalIterator():
        counts[r.lang, r.bucket] = r.n
    return TextModel(languages, counts)


def visible_text(html: bytes | None) -> str:
    """The page without tags, comments, scripts, styles and entities, which become blanks.

    A comment, script or style that is never closed counts as a tag only, and a tag that is never closed as text.  Every
    closing mark is looked for once beyond each place, and a missing one not again, so that broken pages take
    linear time too.
    """
    html, out, at = html or b"", [], 0
    none_left: set[bytes] = set()

    def beyond(mark: bytes, start: int) -> int:
        """End of the next closing mark, or -1."""
        if mark in none_left:
            return -1
        if mark in _RAW_END:
            found = _RAW_END[mark].search(html, start)
            end = found.end() if found else -1
        else:
            place = html.find(mark, start)
            end = place + len(mark) if place >= 0 else -1
        if end < 0:
            none_left.add(mark)
        return end

    def noise_end(i: int) -> int:
        if html[i : i + 1] == b"&":
            entity = _ENTITY.match(html, i)
            return entity.end() if entity else -1
        raw = _RAW.match(html, i)
        end = beyond(raw[1].lower(), raw.end()) if raw else beyond(b"-->", i + 4) if html.startswith(b"<!--", i) else -1
        return end if end >= 0 else beyond(b">", i + 1)

    pos = 0
    while (found := _OPEN.search(html, pos)) is not None:
        end = noise_end(found.start())
        if end < 0:
            pos = found.end()
            continue
        out += [html[at : found.start()], b" "]
        at = pos = end
    out.append(html[at:])
    return b"".join(out).decode("utf-8", "replace")


def _in_tags(html: bytes, opening: re.Pattern, read) -> bytes | None:
    """The first value that ``read`` finds in a tag, from its opening to the next ``>``; every byte is looked at once."""
    at = 0
    while (tag := opening.search(html, at)) is not None:
        end = html.find(b">", tag.end())
        end = len(html) if end < 0 else end
        if (value := read(html, tag.end(), end)) is not None:
            return value
        at = end
    return None


def _lang(html: bytes, start: int, end: int) -> bytes | None:
    found = _LANG.search(html, start, end)
    return found and found[1]


def _content_language(html: bytes, start: int, end: int) -> bytes | None:
    about = _ABOUT_LANGUAGE.search(html, start, end)
    found = about and _CONTENT.search(html, about.end(), end)
    return found and found[1]


def declared_language(html: bytes | None) -> str | None:
    found = html and (_in_tags(html, _HTML, _lang) or _in_tags(html, _META, _content_language))
    return found.decode().lower() if found else None


def _read(model: TextModel):
    def run(batches, schema):
        for batch in batches:
            html = batch.column(1)
            for a, b in tokens.slices(html):
                bodies = html[a:b].to_pylist()
                logs, n = model.evidence(pa.array([visible_text(x) for x in bodies], pa.string()))
                said = [declared_language(x) for x in bodies]
                yield batch_of(
                    {
                        "page_id": batch.column(0)[a:b], "url": batch.column(2)[a:b], "n_grams": n,
                        "declared": ["none" if x is None else x if x in model.languages else "other" for x in said],
                        "logs": pa.ListArray.from_arrays(np.arange(0, logs.size + 1, max(1, logs.shape[1]), dtype=np.int32)[: len(n) + 1], logs.ravel())
                        if logs.shape[1] else pa.array([[]] * len(n), pa.list_(pa.float64())),
                    },
                    schema,
                )

    return run


def identify(
    pages: DataFrame,
    model: TextModel,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    strength: float = STRENGTH,
    alpha: float = ALPHA,
) -> DataFrame:
    """``(page_id, host, declared, text_lang, lang, probability)`` for every page."""
    spark, names = pages.sparkSession, model.languages
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(html).cast("binary").alias("html"), F.col(url).alias("url"))
    path = scratch_path(spark, "evidence")
    ddl = "page_id bigint, url string, n_grams int, declared string, logs array<double>"
    map_batches(rows, _read(model), ddl).write.parquet(path)
    host, _ = url_parts(F.col("url"))
    seen = spark.read.parquet(path).withColumn("host", host)
    languages = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    best = F.try_element_at(languages, F.array_position("logs", F.array_max("logs")).cast("int"))
    seen = seen.withColumn("text_lang", F.when(F.col("n_grams") >= ENOUGH, best)).drop("url")
    if not names:
        empty = F.lit(None)
        return seen.select("page_id", "host", "declared", "text_lang", empty.cast("string").alias("lang"), empty.cast("double").alias("probability"))
    count = F.array(*[F.count(F.when(F.col("text_lang") == x, 1)) for x in names])
    added = F.array(*[F.sum(F.col("n")[i]) for i in range(len(names))])

    def log_given(n: Column, kinds: Column, total: Column, own: Column) -> Column:
        """log P(value | language) for each language, with the page's own count taken out."""
        return F.transform(
            F.arrays_zip(n.alias("n"), total.alias("t"), own.alias("o")),
            lambda x: F.log((x["n"] - x["o"] + alpha) / (x["t"] - x["o"] + alpha * kinds)),
        )

    def shrunk(n: Column, prior: Column, own: Column) -> Column:
        """Dirichlet mean of each language, with the page's own count taken out."""
        size = F.aggregate(F.zip_with(n, own, lambda a, b: a - b), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return F.transform(
            F.arrays_zip(n.alias("n"), prior.alias("p"), own.alias("o")),
            lambda x: (x["n"] - x["o"] + strength * x["p"]) / (size + strength),
        )

    by_host = seen.groupBy("host").agg(count.alias("n"))
    _, domain, suffix = host_levels(F.col("host"))
    by_host = by_host.withColumns({"domain": domain, "suffix": suffix})
    by_domain = by_host.groupBy("domain").agg(added.alias("n_domain"))
    by_suffix = by_host.groupBy("suffix").agg(added.alias("n_suffix"))
    totals = by_suffix.agg(F.array(*[F.coalesce(F.sum(F.col("n_suffix")[i]), F.lit(0)) for i in range(len(names))]), F.count(F.lit(1))).first()
    total, suffixes = F.array(*[F.lit(x) for x in totals[0]]), F.lit(totals[1])
    by_host = by_host.join(by_domain, "domain").join(by_suffix, "suffix").select("host", "n", "n_domain", "n_suffix")
    # At most one row per language and two more.
    by_declared = F.broadcast(seen.groupBy("declared").agg(count.alias("n_declared")))
    own = F.transform(languages, lambda x: F.coalesce((x == F.col("text_lang")).cast("bigint"), F.lit(0).cast("bigint")))
    joined = seen.join(by_declared, "declared").join(by_host, "host").withColumn("own", own)
    flat = F.array(*[F.lit((x + 1.0) / (sum(totals[0]) + len(names))) for x in totals[0]])
    parts = joined.withColumn("prior", shrunk(F.col("n_domain"), flat, F.col("own"))).select(
        "page_id", "host", "declared", "text_lang", "logs",
        log_given(F.col("n_declared"), F.lit(float(len(names) + 2)), total, F.col("own")).alias("l_declared"),
        log_given(F.col("n_suffix"), suffixes, total, F.col("own")).alias("l_suffix"),
        F.transform(shrunk(F.col("n"), F.col("prior"), F.col("own")), lambda x: F.log(x)).alias("l_host"),
    )
    score = F.transform(
        F.arrays_zip("logs", "l_declared", "l_suffix", "l_host"), lambda x: x["logs"] + x["l_declared"] + x["l_suffix"] + x["l_host"]
    )
    scored = parts.withColumn("score", score).withColumn("top", F.array_max("score"))
    weight = F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return scored.select(
        "page_id", "host", "declared", "text_lang",
        F.element_at(languages, F.array_position("score", F.col("top")).cast("int")).alias("lang"),
        F.round(1.0 / weight, 6).alias("probability"),
    )

