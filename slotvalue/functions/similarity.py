"""Name similarity: matching-block ratio of the standard library."""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher


def ratios(first: Iterable[str], second: Iterable[str]) -> list[float]:
    """Matching-block ratio of each pair; the order of a pair matters.

    The second sequence is indexed once for neighbours that share it.
    """
    out, matcher, last = [], SequenceMatcher(), None
    for a, b in zip(first, second, strict=True):
        if b != last:
            matcher.set_seq2(b)
            last = b
        matcher.set_seq1(a)
        out.append(matcher.ratio())
    return out
