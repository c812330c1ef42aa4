"""Portable hashes and vector signatures.

A signature is an array of 32-bit words held in bigints, lowest bits first, so it
can have any length and every word can be used as a join key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32


def digest_number(*parts: Column | str | int, digits: int = 8) -> Column:
    """Number from the leading hex digits of an MD5 over the parts; equal on every engine."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def bernoulli(share: float, *parts: Column | str | int) -> Column:
    """True for about ``share`` of the rows, always for the same ones."""
    return digest_number(*parts) < F.lit(int(share * 2**32))


def pack_bits(bits: Column, length: int) -> Column:
    """Array of booleans to words."""
    words = []
    for start in range(0, length, WORD):
        size = min(WORD, length - start)
        part = F.slice(bits, start + 1, size)
        weighted = F.zip_with(
            part,
            F.array(*[F.lit(1 << i).cast("bigint") for i in range(size)]),
            lambda bit, weight: F.when(bit, weight).otherwise(F.lit(0).cast("bigint")),
        )
        words.append(F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, b: a + b))
    return F.array(*words)


def _mean(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda a, b: a + b) / F.size(vec)


def block_means(vec: Column, length: int, size: int) -> Column:
    """Shrink a vector to ``size`` values by averaging equal runs."""
    run = length // size
    return F.array(*[_mean(F.slice(vec, 1 + i * run, run)) for i in range(size)])


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside a nested lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def average_hash(vec: Column, length: int) -> Column:
    above = _bind(_mean(vec), lambda mean: F.transform(vec, lambda v: v > mean))
    return _bind(above, lambda bits: pack_bits(bits, length))


def gradient_hash(vec: Column, length: int) -> Column:
    rising = F.zip_with(F.slice(vec, 2, length - 1), F.slice(vec, 1, length - 1), lambda b, a: b > a)
    return _bind(rising, lambda bits: pack_bits(bits, length - 1))


def dct_hash(vec: Column, length: int, keep: int) -> Column:
    """Bit = low-frequency cosine coefficient above the median of the kept ones."""
    basis = [
        [math.cos(math.pi * k * (2 * n + 1) / (2 * length)) for n in range(length)]
        for k in range(keep)
    ]
    coefficients = F.array(
        *[
            F.aggregate(
                F.zip_with(vec, F.array(*[F.lit(b) for b in row]), lambda v, b: v * b),
                F.lit(0.0),
                lambda a, b: a + b,
            )
            for row in basis
        ]
    )
    half = keep // 2

    def bits(values: Column) -> Column:
        ranked = F.array_sort(values)
        median = (ranked[half - 1] + ranked[half]) / 2 if keep % 2 == 0 else ranked[half]
        above = _bind(median, lambda m: F.transform(values, lambda c: c > m))
        return _bind(above, lambda b: pack_bits(b, keep))

    return _bind(coefficients, bits)


METHODS = ("average", "gradient", "dct")


def signature(vec: Column, length: int, method: str, size: int) -> tuple[Column, int]:
    """Signature of a vector and its number of bits.

    ``size`` is the number of values the vector is shrunk to (average, gradient) or the
    number of coefficients kept (dct).
    """
    if method == "dct":
        return dct_hash(vec, length, size), size
    if method not in METHODS:
        raise ValueError(method)
    small = vec if size == length else block_means(vec, length, size)
    if method == "average":
        return _bind(small, lambda v: average_hash(v, size)), size
    return _bind(small, lambda v: gradient_hash(v, size)), size - 1


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n
    )
