"""Secret scans: three pattern kinds, and a battery of randomness tests.

Base spans are the matches of the assign, access and hex patterns. The method
adds spans of kind "random": stretches of key characters outside base spans (a
stretch that one touches is cut there) that look uniformly random rather than
written. For each stretch of ``LEAST_RANDOM`` characters or more

* the encoding is inferred from its characters (decimal, hex, lower case, base32,
  base36, base62, base64 or a mixture of its two kinds), which gives an alphabet
  with an order;
* a chi-squared test of uniformity over equal shares of the alphabet, a runs test
  about the alphabet's middle, and a lag-one serial correlation test must none
  reject randomness at level ``ALPHA``; a stretch that one rejects has p-value 1;
* otherwise its p-value is that of "this is written": the likelihood of its
  characters as written text over that as uniform ones, at most 1, which by
  Markov's inequality is at most the level at which written characters get so
  far. Written means each mixture in ``WRITTEN`` of letters, capitals and digits,
  and the largest counts. It falls with each character, so short or plainly
  written stretches can't get a small one;
* the stretches of a document whose p-values pass the Benjamini-Hochberg
  procedure at rate ``RATE``, weighted by length, are reported.

Positions are code points, ends exclusive. Null texts are empty; very long texts
are scanned whole. Rows are independent, so repeated rows, extra columns and empty
tables need no care; an output column of a name that exists replaces it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackloom.llm.common import small_batches

#: The base patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

LEAST_RANDOM = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % LEAST_RANDOM)
ALPHA = 0.001
RATE = 0.05

#: What written text may be: shares of digits among its characters, and of capitals among its letters, where there are both kinds.
WRITTEN = ((0.03, 0.04), (0.03, 0.5), (0.15, 0.04), (0.95, 0.04))
#: Share of each sign among written characters.
SIGN = 0.01

#: Encodings from the narrowest: name, characters in order.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("decimal", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("lower", LOWER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Letters of running text in per cent, a to z.
PROSE = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
#: Digits of running text in per cent, 0 to 9, as in the documents of sf0.1.
NUMBERS = (9.8, 11.2, 10.7, 9.5, 10.8, 12.3, 8.9, 8.6, 8.8, 9.4)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * df)
    return normal_tail(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def infer(token: str) -> tuple[str, str] | None:
    own = set(token.rstrip("="))
    for name, letters in ALPHABETS:
        if own <= set(letters):
            return name, letters
    return None


@lru_cache(maxsize=len(ALPHABETS))
def odds(name: str) -> list[dict[str, float]]:
    """For each way of writing, by character: the logarithm of its likelihood among uniform ones over that among written ones."""
    letters = dict(ALPHABETS)[name]
    signs = [c for c in letters if not c.isalnum()]
    digits = [c for c in letters if c.isdigit()]
    low, high = ([c for c in letters if c.isalpha() and c.isupper() == up] for up in (False, True))
    out = []
    for share, capitals in WRITTEN:
        rest = 1 - SIGN * len(signs)
        for_digits = rest * (share if low or high else 1.0) if digits else 0.0
        for_letters = rest - for_digits
        p = dict.fromkeys(signs, SIGN)
        p |= {c: for_digits * w / sum(NUMBERS[int(d)] for d in digits) for c in digits for w in [NUMBERS[int(c)]]}
        for case, part in ((low, for_letters * (1 - capitals if high else 1.0)), (high, for_letters * (capitals if low else 1.0))):
            total = sum(PROSE[ord(c.lower()) - 97] for c in case)
            p |= {c: part * PROSE[ord(c.lower()) - 97] / total for c in case}
        out.append({c: -math.log(len(letters) * p[c]) for c in letters})
    return out


def battery(token: str) -> tuple[str, list[float], float] | None:
    """(encoding, p-values of the three tests of randomness, p-value of being written) of a stretch; None if no encoding fits."""
    found = infer(token)
    if found is None:
        return None
    name, letters = found
    rank = {c: i for i, c in enumerate(letters)}
    body = token.rstrip("=")
    values = [rank[c] for c in body]
    n, k = len(values), len(letters)
    bins = max(2, min(k // 2, n // 5))
    counts, size = [0] * bins, [0] * bins
    for v in values:
        counts[v * bins // k] += 1
    for i in range(k):
        size[i * bins // k] += 1
    uniform = chi_tail(sum((o - n * s / k) ** 2 / (n * s / k) for o, s in zip(counts, size, strict=True)), bins - 1)
    high = [2 * v >= k for v in values]
    n1 = sum(high)
    n0 = n - n1
    if n1 and n0:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 1 + 2 * n1 * n0 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 0.0
    m = sum(values) / n
    spread = sum((v - m) ** 2 for v in values)
    serial = sum((a - m) * (b - m) for a, b in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    p_serial = 2 * normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    least = min(sum(map(way.__getitem__, body)) for way in odds(name))
    return name, [uniform, p_runs, p_serial], math.exp(-max(0.0, min(least, 690.0)))


def discoveries(tokens: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Stretches that pass the battery and the weighted Benjamini-Hochberg procedure."""
    tested = [(a, b, got[2] if min(got[1]) >= ALPHA else 1.0) for a, b, t in tokens if (got := battery(t)) is not None]
    if not tested:
        return []
    mean = sum(b - a for a, b, _ in tested) / len(tested)
    ranked = sorted((p / ((b - a) / mean), a, b) for a, b, p in tested)
    last = max((k for k, r in enumerate(ranked, 1) if r[0] <= RATE * k / len(ranked)), default=0)
    return sorted((a, b) for _, a, b in ranked[:last])


def outside(a: int, b: int, spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the spans, in order of their starts, leave of a stretch."""
    for s, e in spans:
        if e <= a:
            continue
        if s >= b:
            break
        if s > a:
            yield a, s
        a = max(a, e)
    if a < b:
        yield a, b


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, in order."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in spans)
    reach = list(accumulate((b for _, b in base), max))
    free = []
    for m in CANDIDATE.finditer(text):
        # the first base span that ends after the stretch begins
        k = bisect_right(reach, m.start())
        free += [(a, b, text[a:b]) for a, b in outside(*m.span(), islice(base, k, None)) if b - a >= LEAST_RANDOM]
    spans += [(a, 3, b) for a, b in discoveries(free)]
    return sorted(spans)


def with_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with an array of (kind, start, end), by start, then kind as in KINDS."""
    small_batches(df.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in texts.to_pylist()], kind)

    return df.withColumn(out, scanned(F.col(text_col)))


def without_secrets(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by a mark."""
    small_batches(df.sparkSession)

    def masked(text: str | None) -> str | None:
        spans = scan(text)
        if not spans:
            return text
        out, at = [], 0
        for a, _, b in spans:
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], mark]
            at = b
        return "".join(out) + text[at:]

    @arrow_udf("string")
    def masks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([masked(t) for t in texts.to_pylist()], pa.string())

    return df.withColumn(text_col, masks(F.col(text_col)))
