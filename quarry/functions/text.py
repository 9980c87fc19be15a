"""Lines, tokens, spans, secrets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a text's lines end: what str.splitlines takes for an end.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines(text: Column) -> Column:
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def n_tokens(text: Column) -> Column:
    """A fourth of the characters, at least 1; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def window_starts(n: Column, size: int, step: int) -> Column:
    """Starts (from 0) of windows of ``size`` lines that reach the end: none beyond the first that does."""
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step, F.lit(step)))


def span(parts: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, inclusive, the end clamped), joined."""
    return F.array_join(F.slice(parts, first, F.greatest(F.lit(0), F.least(last, F.size(parts)) - first + 1)), "\n")


def span_error(parts: Column, first: Column, last: Column) -> Column:
    return F.when(first < 1, "start below 1").when(first > F.size(parts), "start beyond the end").when(last < first, "end before start")


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n  # noqa: E731  one pass for each distinct character
    shares = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), share)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+"
LABELLED = r"(?i)\b(api[_-]?key|token|secret|password)\b(\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;]+)"
LONG_TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
MASK = "***"
LEAST_ENTROPY = 3.5


#: A text without any of these words needs neither of the first two expressions.
LABELS = ("bearer", "api", "token", "secret", "password")


def without_labels(text: Column) -> Column:
    """Bearer tokens and labelled secrets are masked."""
    low = F.lower(text)
    some = reduce(lambda a, b: a | b, (low.contains(w) for w in LABELS))
    return F.when(some, F.regexp_replace(F.regexp_replace(text, BEARER, f"Bearer {MASK}"), LABELLED, f"$1$2{MASK}")).otherwise(text)


#: Where a long word begins; tried at the beginnings of words only, as most texts have none.
LONG_START = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24}"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is evaluated a single time."""
    return F.transform(F.array(value), use)[0]


def redacted(text: Column) -> Column:
    """Bearer tokens, labelled secrets, and long words of high entropy are masked."""

    def spliced(t: Column, found: Column) -> Column:
        masked = F.transform(found, lambda w: F.when(entropy(w) >= LEAST_ENTROPY, F.lit(MASK)).otherwise(w))
        return F.array_join(F.flatten(F.zip_with(F.split(t, LONG_TOKEN, -1), masked, lambda g, w: F.array(g, F.coalesce(w, F.lit(""))))), "")

    long = lambda t: once(F.regexp_extract_all(t, F.lit(LONG_TOKEN), F.lit(0)), lambda found: spliced(t, found))
    return once(without_labels(text), lambda t: F.when(t.rlike(LONG_START), long(t)).otherwise(t))


def average_line(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.length(x)) / F.greatest(F.lit(1), F.size(parts))


def is_minified(path: Column, parts: Column, kind: str) -> Column:
    """By name (.min.js, .min.css) or average line length (800 for scripts, 200 for style sheets)."""
    return path.endswith(f".min.{kind}") | (average_line(parts) > (800 if kind == "js" else 200))
