r"""Secrets in texts: fixed patterns, and a battery of randomness tests for other strings.

The base patterns find assignments to words like *password*, access keys and hexadecimal runs.  Every other run of
key characters that is long enough is a candidate.  Its encoding (hexadecimal, base 32, base 36, base 64) is
inferred from the characters it uses; under the hypothesis that it is a random string in that encoding it
undergoes three tests: chi-squared uniformity over groups of the alphabet, the runs test about the
alphabet's middle, and the serial correlation of neighbours.  Fisher's method combines the three p-values.

Which candidates are *not* random is decided over the whole corpus by the Benjamini-Hochberg procedure within
each length class, since long strings give much surer p-values than short ones.  The candidates that stay
are spans of kind ``random``.  A candidate needs a letter and a digit, and doesn't overlap a base span.

A null text counts as empty.  Repeated rows get equal spans (each row counts as evidence of its own).
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneframe.llm.common import settle, thin

#: fixed patterns: kind -> (pattern, least length of the secret part, its group)
BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 12, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 16, 0),
}
KINDS = [*BASE, "random"]
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: share of random strings that may be lost among those called ordinary
FALSE_DISCOVERY = 0.01
#: alphabets in the order they are tried
_ALPHABETS = [
    ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
_ORDERS = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in _ALPHABETS]


def infer_encoding(string: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that holds the string (without padding)."""
    used = set(string.rstrip("="))
    return next(((name, order) for name, order in _ORDERS if used <= order.keys()), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, freedom: int) -> float:
    """Upper tail of chi-squared, by the cube-root normal approximation."""
    v = 2 / (9 * freedom)
    return 0.5 * math.erfc(((x / freedom) ** (1 / 3) - 1 + v) / math.sqrt(2 * v))


def p_values(values: list[int], size: int) -> tuple[float, float, float]:
    """Uniformity, runs and serial correlation of symbols 0..size-1."""
    n = len(values)
    groups = max(2, min(size, n))
    counts = [0] * groups
    for v in values:
        counts[v * groups // size] += 1
    widths = [0] * groups
    for v in range(size):
        widths[v * groups // size] += 1
    uniform = _chi_tail(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, widths)), groups - 1)
    high = [2 * v >= size for v in values]
    ones = sum(high)
    zeros = n - ones
    if not ones or not zeros:
        runs = 2.0 ** (1 - n)
    else:
        mean = 1 + 2 * ones * zeros / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = _normal_tail((1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    centre = sum(values) / n
    power = sum((v - centre) ** 2 for v in values)
    if not power:
        return uniform, runs, 0.0
    serial = sum((a - centre) * (b - centre) for a, b in zip(values, values[1:])) / power
    return uniform, runs, _normal_tail((serial + 1 / n) * math.sqrt(n))


def randomness(string: str) -> float:
    """Combined p-value of the string being random in its encoding; 0 without an encoding."""
    found = infer_encoding(string)
    if found is None:
        return 0.0
    values = [found[1][c] for c in string.rstrip("=")]
    if len(values) < 16:
        return 0.0
    x = -2 * sum(math.log(max(p, 1e-300)) for p in p_values(values, len(found[1])))
    return math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2)          # chi-squared with six degrees


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted."""
    out = []
    for k, (pattern, least, group) in enumerate(BASE.values()):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of key-like runs with a letter and a digit that overlap no base span."""
    out = []
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) \
                and not any(a < m.end() and m.start() < b for a, _, b in taken):
            out.append((m.start(), m.end()))
    return out


def _scan(batches):
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    maybe = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("length", pa.int32()), ("p", pa.float64())]))
    for batch in thin(batches):
        base, more, hashes = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            found = base_spans(text)
            base.append([{"start": a, "kind": k, "stop": b} for a, k, b in found])
            hashes.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest())
            more.append([{"start": a, "stop": b, "length": (b - a).bit_length(), "p": randomness(text[a:b])}
                         for a, b in candidates(text, found)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(more, maybe), pa.array(hashes)],
                                         names=["doc_id", "base", "maybe", "base_sha256"])


def ordinary_below(maybe: DataFrame, level: float = FALSE_DISCOVERY) -> list[float]:
    """For each length class 0..31: the p-value up to which a candidate is called ordinary.

    Benjamini-Hochberg on counts of p-values in classes of a fortieth of a power of ten; one map-side combined aggregate.
    """
    grade = F.least(F.lit(4000), F.floor(-F.log10(F.greatest("p", F.lit(1e-100))) * 40)).cast("int")
    rows = maybe.groupBy("length", grade.alias("grade")).agg(F.count(F.lit(1)).alias("n")).collect()
    limits = [0.0] * 32
    for length in {r["length"] for r in rows}:
        own = sorted(((r["grade"], r["n"]) for r in rows if r["length"] == length), reverse=True)
        total, below = sum(n for _, n in own), 0
        for g, n in own:                               # from the smallest p-values
            below += n
            top = 10.0 ** (-g / 40)                     # the largest p-value of the class
            if top <= level * below / total:
                limits[length] = top
    return limits


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base_sha256`` and ``found`` (start, kind number, stop), sorted."""
    rows = settle(docs.select("doc_id", "text").mapInArrow(
        _scan, "doc_id long, base array<struct<start:int,kind:int,stop:int>>, "
               "maybe array<struct<start:int,stop:int,length:int,p:double>>, base_sha256 string"))
    limits = F.array(*[F.lit(x) for x in ordinary_below(rows.select(F.explode("maybe").alias("m")).select("m.length", "m.p"))])
    kept = F.filter("maybe", lambda m: m["p"] > F.element_at(limits, m["length"] + 1))
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(len(BASE)).alias("kind"), m["stop"].alias("stop")))
    return rows.select("doc_id", "base_sha256", F.array_sort(F.concat("base", spans)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """op6: counts of the base kinds, their hash, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform("found", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], "base_sha256",
                        F.array_join(text, ",").alias("spans"))
