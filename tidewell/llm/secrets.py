"""Secret scanning: fixed patterns, and a randomness test battery over key-like tokens.

Patterns give the base spans: assignments of a password-like name, access ids, long hex runs. The battery then looks at every run
of key characters that no base span covers: it infers the smallest encoding that explains the run (hex, base32, base36, base62,
base64 with + and /, or with - and _) and tests the hypothesis "uniform symbols of that encoding" four ways: chi-squared over the symbols, chi-squared over the
character classes, runs about the middle of the alphabet, and lag-1 serial correlation. The smallest of the four p-values, corrected
for being that (Sidak), is near uniform over tokens that are random.
A run is tested as the longest pieces without - and _, the longest without + and /, and the longest of letters and digits alone, so
that a key in a path or a dashed name is tested by itself too. Runs without digits or without letters are tested like all others.

Discoveries are controlled on both sides within a class of (encoding, length octave), from counts of p-values over all
documents, so that short tokens, whose tests are weak, never dilute long ones. Tokens that are *not* random are found by
Benjamini-Hochberg. Of those left, random ones have a flat density, which the p-values above one half show (Storey's estimate); what
exceeds it are false alarms, and the least p-value that is reported is raised until their share among the reported is at
most ``FALSE_DISCOVERY``. A token is reported where it passes both, its length carries at least ``BITS`` bits (15 characters of 64, 16
of 62, 18 of 32 or 36, 23 of 16), and no longer piece around it is reported; two pieces that only overlap are both reported. The
counts are a mergeable histogram with logarithmic bins.

Null text is empty and has no spans. An empty table gives an empty result. Texts are scanned whole; rows are independent, so repeated
rows repeat and null doc_ids are carried along. Only doc_id and text are read; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.scratch import keep

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

NAMES = ("pass", "secret", "token", "api")
FALSE_DISCOVERY, BITS, BINS = 0.05, 90.0, 400
#: Bins above a p-value of one half, where tokens that are not random are taken to be few.
FLAT = 3
#: Fewest characters that carry ``BITS`` in the largest encoding.
LEAST = math.ceil(BITS / 6)
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
PLAIN, *WIDE = (re.compile(r"[A-Za-z0-9%s]{%d,}" % (x, LEAST)) for x in ("", "+/", "_-"))
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Name, alphabet, sizes of its character classes.
ENCODINGS = (
    ("hex", _DIGIT + "abcdef", (10, 6)),
    ("HEX", _DIGIT + "ABCDEF", (10, 6)),
    ("base32", _UPPER + "234567", (26, 6)),
    ("base36", _DIGIT + _LOWER, (10, 26)),
    ("BASE36", _DIGIT + _UPPER, (10, 26)),
    ("base62", _UPPER + _LOWER + _DIGIT, (26, 26, 10)),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/", (26, 26, 10, 2)),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_", (26, 26, 10, 2)),
)
_TABLES = [(name, frozenset(a), {c: i for i, c in enumerate(a)}, classes) for name, a, classes in ENCODINGS]


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    return _upper_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) if x > 0 else 1.0


def encoding_of(token: str) -> int:
    """Index of the smallest encoding that has all symbols; -1 if none."""
    seen = set(token)
    return next((i for i, t in enumerate(_TABLES) if seen <= t[1]), -1)


def battery(token: str, encoding: int) -> tuple[float, float, float, float]:
    """p-values of symbol uniformity, class uniformity, runs and serial correlation; small where the token is not random."""
    _, _, place, classes = _TABLES[encoding]
    x, n, k = [place[c] for c in token], len(token), len(place)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    expected = n / k
    symbols = _chi2(sum(c * c for c in counts.values()) / expected - n, k - 1)
    bounds, found = [], [0] * len(classes)
    for size in classes:
        bounds.append((bounds[-1] if bounds else 0) + size)
    for v, c in counts.items():
        found[next(i for i, b in enumerate(bounds) if v < b)] += c
    kinds = _chi2(sum((f - n * s / k) ** 2 / (n * s / k) for f, s in zip(found, classes, strict=True)), len(classes) - 1)
    high = [v >= k / 2 for v in x]
    up = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    if up in (0, n):
        p_runs = 2.0 ** (1 - n)
    else:
        mean = 1 + 2 * up * (n - up) / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    r = sum((a - m) * (b - m) for a, b in zip(x, x[1:], strict=False)) / spread if spread else 1.0
    serial = 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n))
    return symbols, kinds, p_runs, serial


def combined(ps: tuple[float, ...]) -> float:
    least = min(1.0, *ps)
    return -math.expm1(len(ps) * math.log1p(-least)) if least < 1 else 1.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float, list[tuple[int, int, float]]]]:
    """(start, end, encoding, length octave, p, the last three of the pieces around it) of key-like pieces that no base span touches
    and that are long enough."""
    # Base spans as disjoint intervals: one bisection tells whether a piece touches any.
    starts, ends = [], []
    for s, _, t in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], t)
        else:
            starts.append(s)
            ends.append(t)

    def touched(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    tested: dict[tuple[int, int], tuple[int, int, float] | None] = {}
    around: dict[tuple[int, int], list] = {}

    def test(a: int, b: int) -> tuple[int, int, float] | None:
        if (a, b) not in tested:
            e = encoding_of(text[a:b])
            short = e < 0 or (b - a) * math.log2(len(_TABLES[e][1])) < BITS
            ok = not short and not touched(a, b)
            tested[a, b], around[a, b] = (e, (b - a).bit_length(), combined(battery(text[a:b], e))) if ok else None, []
        return tested[a, b]

    for m in RUN.finditer(text):
        for pieces in WIDE:
            for wide in pieces.finditer(text, *m.span()):
                outer = test(*wide.span())
                for part in PLAIN.finditer(text, *wide.span()):
                    if part.span() != wide.span() and test(*part.span()) and outer:
                        around[part.span()].append(outer)
    return [(*span, *found, around[span]) for span, found in sorted(tested.items()) if found]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_CLASS = [("encoding", pa.int32()), ("octave", pa.int32()), ("bin", pa.int32())]
_CAND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("octave", pa.int32()), ("bin", pa.int32()), ("around", pa.list_(pa.struct(_CLASS)))]))
SCHEMA = "doc_id long, base array<struct<start: long, kind: int, end: long>>, found array<struct<start: long, end: long, encoding: int, octave: int, bin: int, around: array<struct<encoding: int, octave: int, bin: int>>>>"


def bin_of(p: float) -> int:
    """Logarithmic bins of 1/10 decade; 0 holds p = 1, larger bins smaller p."""
    return min(BINS, math.floor(-10 * math.log10(p))) if p > 1e-300 else BINS


def classed(encoding: int, octave: int, p: float) -> dict[str, int]:
    return {"encoding": encoding, "octave": octave, "bin": bin_of(p)}


def scan(docs: DataFrame, per_batch: int = 1000) -> DataFrame:
    """Base spans and battery results of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, per_batch):
                batch = whole.slice(i, per_batch)
                base, found = [], []
                for text in batch.column(1).to_pylist():
                    b = base_spans(text or "")
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in b])
                    found.append([{"start": s, "end": e, **classed(c, o, p), "around": [classed(*x) for x in around]} for s, e, c, o, p, around in candidates(text or "", b)])
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(base, _SPAN), pa.array(found, _CAND)], names=["doc_id", "base", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def thresholds(scanned: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """(encoding, octave, limit): a token is random where its bin is below ``limit``. At most one row per class.

    Benjamini-Hochberg on the histogram: the largest p-value whose rank r satisfies p <= q r / m, with p the upper edge of its bin.
    False alarms: of N tokens with p above t, ``m0 (1 - t)`` are random, m0 being what the bins above one half would give over
    all p, with two standard errors and one token more; the lowest t whose remaining share is at most q bounds the limit.
    """
    counts = scanned.select(F.explode("found").alias("c")).groupBy("c.encoding", "c.octave", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("encoding", "octave")
    run = lambda order: F.sum("n").over(w.orderBy(order))
    top = F.coalesce(F.sum(F.when(F.col("bin") < FLAT, F.col("n"))).over(w), F.lit(0))
    ranked = counts.select("*", run(F.col("bin").desc()).alias("rank"), F.sum("n").over(w).alias("m"), run(F.col("bin")).alias("above"), top.alias("top"))
    passes = F.pow(F.lit(10.0), -F.col("bin") / 10) <= q * F.col("rank") / F.col("m")
    random = (F.col("top") + 1 + 2 * F.sqrt(F.col("top"))) / (1 - 10 ** (-FLAT / 10)) * (1 - F.pow(F.lit(10.0), -(F.col("bin") + 1) / 10))
    clean = (F.col("bin") < FLAT) | (1 - random / F.col("above") <= q)
    return ranked.groupBy("encoding", "octave").agg(F.least(F.coalesce(F.min(F.when(passes, F.col("bin"))), F.lit(BINS + 1)), F.coalesce(F.max(F.when(clean, F.col("bin") + 1)), F.lit(FLAT))).alias("limit"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans (start, kind, end) of every document."""
    scanned = keep(scan(docs), "secret-scan")
    # At most a row per (encoding, octave): 8 encodings times 31 octaves, whatever the corpus.
    limits = [x for r in thresholds(scanned).collect() for x in (F.lit(f"{r.encoding}:{r.octave}"), F.lit(r.limit))]
    limit = F.create_map(*limits) if limits else F.create_map(F.lit(""), F.lit(0))
    stands = lambda c: c["bin"] < F.element_at(limit, F.concat_ws(":", c["encoding"], c["octave"]))
    random = F.filter("found", lambda c: stands(c) & ~F.exists(c["around"], stands))
    random = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", F.sort_array(F.concat("base", random)).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return detect(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["kind"] == 3)).cast("long").alias("n_random"),
    )
