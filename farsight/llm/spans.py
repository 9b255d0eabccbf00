"""Places of pattern matches with DataFrame functions only, in time linear but for a logarithm."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def running(values: Column, combine, empty: int = 0) -> Column:
    """Running ``combine`` (sum, greatest, ...) over an array of numbers.

    Each round combines every value with the one a power of two before it, so an array of n values
    takes log n passes; an accumulator that grows value by value would copy itself n times.
    """
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(values))

    def shift(acc: Column, by: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(empty), by), F.slice(acc, 1, F.size(acc) - by))

    return F.aggregate(steps, values, lambda acc, by: F.zip_with(acc, shift(acc, by), lambda a, b: combine(a, b)))


def matched(text: Column, pattern: str, trigger: str | None = None) -> Column:
    """All matches of ``pattern``, leftmost and without overlap; a text without ``trigger`` is not searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if trigger is None else F.when(F.contains(text, F.lit(trigger)), found).otherwise(F.array().cast("array<string>"))


def pieces(text: Column, pattern: str, matches: Column) -> Column:
    """The text around the ``matches``: piece i stands before match i, one more after the last."""
    return F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def ends(parts: Column, matches: Column) -> Column:
    """Where each match ends, in code points: the running sum of the pieces and matches up to it."""
    return running(F.zip_with(F.slice(parts, 1, F.size(matches)), matches, lambda a, b: F.length(a) + F.length(b)), lambda a, b: a + b)


def free_of(spans: Column, fixed) -> Column:
    """The sorted ``spans`` (start, kind, end, ...) without those that are not ``fixed`` and overlap one that is.

    The greatest end of fixed spans before a span and the least start of fixed ones after it decide,
    both running values; no span is compared with every other.
    """
    far = 1 << 30
    before = running(F.transform(spans, lambda s: F.when(fixed(s), s["end"]).otherwise(0)), F.greatest)
    starts = F.reverse(F.transform(spans, lambda s: F.when(fixed(s), s["start"]).otherwise(far)))
    after = F.reverse(running(starts, F.least, far))
    zipped = F.arrays_zip(spans.alias("span"), before.alias("before"), after.alias("after"))
    kept = F.filter(zipped, lambda z: fixed(z["span"]) | ((z["before"] <= z["span"]["start"]) & (z["after"] >= z["span"]["end"])))
    return F.transform(kept, lambda z: z["span"])
