"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text and the prefixes of its words, hashed to ``2^18``. The model scores
``sigmoid(bias + a sum w_i r_i x_i + b sum_{i<j} <v_i, v_j> x_i x_j)``: factors ``v`` learn pairs, such as an insult next to the
mention of a group, that no additive weight can express. All terms of the fitted rows have factors. The fixed weight ``r``, from
``LEAST_WEIGHT`` to 1, says how far a term alone separates the classes (its z-score over 3, squared): it slows the weights of terms that
tell nothing alone, which would otherwise learn single rows by heart, and does not touch pairs. ``a`` and ``b`` scale by length.

It is fitted on at most about ``SAMPLE`` labelled rows (a documented bound, chosen by a hash of doc_id), in ``EPOCHS`` passes whatever
their number; scoring covers every row and whole texts. Rows with ``crc32(doc_id) % 4 = 2`` never take part in the fit. Inputs of a
score are the words of the text alone.

Null text is empty; an empty text gets the score of the bias, as does any text without terms of the fitted rows. Rows whose label is
null, or whose doc_id has no document, are not used; several labels of one doc_id count once, toxic if any says so. Repeated
rows score alike. Without usable labels every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, RANK, EPOCHS, BATCH = 12_000, 8, 12, 128
TERM_BITS, PREFIXES = 18, (4, 5)
THRESHOLD, LEAST_WEIGHT = 0.3, 0.1
SEED = 7
_WORD = re.compile(r"\w+")
_CACHE = 300_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


class Terms:
    """Hashed terms of words, remembered."""

    def __init__(self):
        self.seen: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        out = self.seen.get(word)
        if out is None:
            parts = ["w" + word, *(f"p{word[:n]}" for n in PREFIXES if len(word) > n)]
            out = tuple(dict.fromkeys(xxhash.xxh3_64_intdigest(p.encode()) >> (64 - TERM_BITS) for p in parts))
            if len(self.seen) > _CACHE:
                self.seen.clear()
            self.seen[word] = out
        return out

    def of_text(self, text: str) -> list[int]:
        of = self.of_word
        return sorted({i for w in set(_WORD.findall(text.lower())) for i in of(w)})


@dataclass
class Model:
    """``place`` has the row of a term in ``w``, ``r`` and ``v``; -1 for terms that no fitted row has."""

    bias: float
    place: np.ndarray
    w: np.ndarray
    r: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        if len(self.w) and any(rows):
            flat = self.place[np.fromiter(chain.from_iterable(rows), np.int64)]
            at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
            lens = np.bincount(at[flat >= 0], minlength=len(rows))
            out = out + _raw(flat[flat >= 0], lens, self.w, self.r, self.v)[0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _segments(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty ones included."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]


def _raw(flat: np.ndarray, lens: np.ndarray, w: np.ndarray, r: np.ndarray, v: np.ndarray):
    """Linear and pairwise part of each row; also the sums of factors, and the scales of both parts."""
    factors = v[flat]
    alone, pairs = 1 / np.sqrt(_segments(r[flat], lens) / 8 + 1), 1 / (lens / 8 + 1)
    s, q = _segments(factors, lens), _segments((factors**2).sum(1), lens)
    return alone * _segments(w[flat] * r[flat], lens) + pairs * 0.5 * ((s**2).sum(1) - q), s, alone, pairs


def fit(flat: np.ndarray, lens: np.ndarray, y: np.ndarray) -> Model:
    """AdaGrad on the log loss, with a small penalty; the same rows in the same order give the same model.

    ``flat`` has the terms of all rows one after the other, ``lens`` their numbers.
    """
    n, pos = len(lens), float(y.sum())
    if not n:
        return Model(-30.0, np.full(1 << TERM_BITS, -1, np.int32), np.zeros(0), np.zeros(0), np.zeros((0, RANK)))
    known, df = np.unique(flat, return_counts=True)
    f = len(known)
    place = np.full(1 << TERM_BITS, -1, np.int32)
    place[known] = np.arange(f)
    ends = np.cumsum(lens)
    flat = place[flat]
    rate, dp = pos / n, np.bincount(flat, np.repeat(y, lens), f)
    z = (dp - df * rate) / np.sqrt(df * rate * (1 - rate) * (1 - df / n) + 1e-9)
    r = np.clip((z / 3) ** 2, LEAST_WEIGHT, 1)
    rng = np.random.default_rng(SEED)
    w, v, bias = np.zeros(f), rng.normal(0, 0.05, (f, RANK)), math.log((pos + 1) / (n - pos + 1))
    gw, gv, gb = np.full(f, 1e-3), np.full((f, RANK), 1e-3), 1e-3
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate_w, rate_v = 0.3 / (1 + epoch / 4), 0.1 / (1 + epoch / 4)
        for i in range(0, n, BATCH):
            some = order[i : i + BATCH]
            own = lens[some]
            terms = np.concatenate([flat[ends[j] - lens[j] : ends[j]] for j in some])
            raw, s, alone, pairs = _raw(terms, own, w, r, v)
            err = (1 / (1 + np.exp(-np.clip(raw + bias, -30, 30))) - y[some]) / len(some)
            g = err.sum()
            gb += g * g
            bias -= 0.2 * g / math.sqrt(gb)
            if not len(terms):
                continue
            here, at = np.unique(terms, return_inverse=True)
            dw = np.bincount(at, np.repeat(err * alone, own) * r[terms]) + 1e-6 * w[here]
            pair = np.repeat(err * pairs, own)[:, None] * (np.repeat(s, own, 0) - v[terms])
            dv = np.stack([np.bincount(at, pair[:, k]) for k in range(RANK)], 1) + 1e-6 * v[here]
            gw[here] += dw * dw
            gv[here] += dv * dv
            w[here] -= rate_w * dw / np.sqrt(gw[here])
            v[here] -= rate_v * dv / np.sqrt(gv[here])
    return Model(bias, place, w.astype(np.float32), r.astype(np.float32), v.astype(np.float32))


def _term_rows(df: DataFrame, text: int, schema: str, rest: list[int], per_batch: int = 1000) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            ids = [np.array(terms.of_text(t or ""), "<u4").tobytes() for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(ids, pa.binary())], names=names)

    return df.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows outside the held-out part."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    if n > sample:
        # The share is taken from the 2^63 values of a hash, so it does not vanish however many labels there are.
        usable = usable.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id")), 1) < (sample << 63) // n)
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("doc_id", "toxic", "text")
    found = _term_rows(rows, 2, "doc_id long, toxic int, terms binary", [0, 1]).toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    lens = pc.binary_length(found.column("terms")).to_numpy().astype(np.int64) // 4
    toxic = found.column("toxic").to_numpy().astype(float).clip(0, 1)
    flat = np.empty(int(lens.sum()), "<u4")
    at = 0
    for chunk in found.column("terms").chunks:
        for terms in chunk:
            part = np.frombuffer(terms.as_buffer() or b"", "<u4")
            flat[at : at + len(part)] = part
            at += len(part)
    del found
    return fit(flat, lens, toxic)


def score(docs: DataFrame, model: Model, per_batch: int = 1000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for whole in batches:
            for i in range(0, whole.num_rows, per_batch):
                batch = whole.slice(i, per_batch)
                p = model.scores([terms.of_text(t or "") for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
