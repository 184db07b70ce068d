"""Quality rules with thresholds that adapt to each language and source.

Every document gets ratios (symbols, capitals, repeated words, repeated lines) and a mean word length. The ratios of all
documents that pass the base rule are summarised per (lang, source) by a mergeable quantile sketch: counts in buckets whose
bounds grow by a constant factor (DDSketch), so that merging is addition, any partitioning gives the same sketch, and each
quantile is exact to ``2 %``. Small groups borrow the merged sketch of their language, then that of all documents. A metric is
out of bounds beyond ``median + half + reach * max(2 half, spread)`` of its group; the filter joins documents with these bounds.
``half`` is the distance from Q1 to the median, so this is ``Q3 + reach * max(Q3 - Q1, spread)`` where a metric is symmetric, and
junk, which lies above, does not move a bound into itself before it is half of a group; beyond that it sets its own bounds.
Junk lies on both sides of the mean word length, whose ``half`` is the lesser of the distances from the median to Q1 and Q3.

Only DataFrame functions run. Null text counts as no words, null lang and null source are groups of their own, and an empty
table gives an empty result. Extra columns pass through ``apply_rules`` whatever their names.
Rows are never merged, so repeated rows stay repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.scratch import keep
from tidewell.llm.words import words_of

SYMBOLS = "#*$%&|<>"
#: Latin capitals; the second row has those beyond ASCII.
CAPITALS = "".join(map(chr, range(65, 91))) + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
METRICS = ("symbol_ratio", "capital_ratio", "repeat_ratio", "dup_line_ratio", "mean_word")
#: Least spread of each metric that a bound allows for, so that a group without variation keeps slight deviations. Three spreads are
#: less than what the base rule allows, and more than the good documents of sf0.1 reach.
SPREAD = {"symbol_ratio": 0.01, "capital_ratio": 0.02, "repeat_ratio": 0.12, "dup_line_ratio": 0.12, "mean_word": 1.0}
REACH = 3.0
#: Growth of bucket bounds, and the value below which all count as zero.
GROWTH, LEAST = 1.04, 1e-4
MIN_GROUP = 50
_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(tri: Column) -> Column:
    """Words in windows that occur again: windows sorted with their places, neighbours compared, places merged."""
    placed = F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

    def again(x, i, s):
        before = F.get(s, i - 1)["h"] == x["h"]
        after = F.get(s, i + 1)["h"] == x["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    # A one-element array binds an expression to a name, so that it is computed once.
    bound = F.transform(F.array(placed), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: again(x, i, s)), lambda x: x["at"])))
    covered = F.transform(
        bound,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b
        ),
    )
    return F.get(covered, F.lit(0))


def _one(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once: a one-element array binds it to the lambda's name."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _of_words(w: Column) -> Column:
    def windows(h):
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    tri = _one(F.transform(w, lambda x: F.xxhash64(x)), windows)
    repeats = _one(tri, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(_repeated(v)))
    return F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeats.alias("repeats"))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The base counts of every row, over its whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    without = lambda chars: F.length(F.regexp_replace(t, f"[{chars}]+", ""))
    out = docs.withColumns({
        "_words": _one(words_of(t), _of_words),
        "_lines": _one(lines, lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("d"))),
        "_symbols": F.length(t) - without(SYMBOLS),
        "_capitals": F.length(t) - without(CAPITALS),
    })
    named = {"n_words": "_words.n", "word_chars": "_words.chars", "n_symbols": "_symbols", "n_dup_lines": "_lines.d", "n_repeat_words": "_words.repeats", "n_lines": "_lines.n", "n_capitals": "_capitals"}
    out = out.withColumns({k: F.col(v).cast("long") for k, v in named.items()}).drop("_words", "_lines", "_symbols", "_capitals")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def metric(name: str) -> Column:
    """A metric as a function of the counts; 0 where its base is empty."""
    top, base = {
        "symbol_ratio": ("n_symbols", "word_chars"),
        "capital_ratio": ("n_capitals", "word_chars"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "mean_word": ("word_chars", "n_words"),
    }[name]
    return F.when(F.col(base) > 0, F.col(top) / F.col(base)).otherwise(F.lit(0.0))


def sketch(features: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the rows that pass the base rule. Sketches merge by summing n."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), metric(m).alias("v")) for m in METRICS])
    rows = features.where(~F.col("base_failed")).select("lang", "source", F.explode(entries).alias("e")).select("lang", "source", "e.*")
    bucket = F.when(F.col("v") < LEAST, F.lit(0)).otherwise(F.ceil(F.log(F.col("v") / LEAST) / math.log(GROWTH)) + 1).cast("int")
    return rows.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Q1, median, Q3 and the row count of each group of a sketch."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("rows"))

    first = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("rows")), F.col("bucket")))
    found = run.groupBy(*keys, "metric").agg(first(0.25).alias("b1"), first(0.5).alias("b2"), first(0.75).alias("b3"), F.max("rows").alias("rows"))
    at = lambda b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(GROWTH), F.col(b) - 1.5))

    return found.select(*keys, "metric", "rows", at("b1").alias("q1"), at("b2").alias("q2"), at("b3").alias("q3"))


def bounds(sketches: DataFrame, min_group: int = MIN_GROUP, reach: float = REACH) -> DataFrame:
    """A row per (lang, source) with the upper bound of each metric, and the lower one of mean_word."""
    own, by_lang, overall = quartiles(sketches, ["lang", "source"]), quartiles(sketches, ["lang"]), quartiles(sketches, [])
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    o, l, a = named(own, "o"), named(by_lang, "l"), named(overall, "a")
    joined = o.join(l, F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_metric") == F.col("l_metric"))).join(a, F.col("o_metric") == F.col("a_metric"))
    pick = lambda c: F.when(F.col("o_rows") >= min_group, F.col(f"o_{c}")).when(F.col("l_rows") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    spread = F.element_at(F.create_map(*[x for m, s in SPREAD.items() for x in (F.lit(m), F.lit(s))]), F.col("o_metric"))
    half = pick("q2") - pick("q1")
    half = F.when(F.col("o_metric") == "mean_word", F.least(half, pick("q3") - pick("q2"))).otherwise(half)
    width = half + reach * F.greatest(2 * half, spread)
    rows = joined.select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"), F.col("o_metric").alias("metric"), (pick("q2") + width).alias("top"), (pick("q2") - width).alias("low"))
    per = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return rows.groupBy("lang", "source").agg(*[per(m, "top").alias(f"top_{m}") for m in METRICS], per("mean_word", "low").alias("low_mean_word"))


def judged(features: DataFrame, limits: DataFrame) -> DataFrame:
    """Features joined with their group's bounds; ``kept`` is the verdict."""
    lim = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in limits.columns if c.startswith(("top_", "low_"))])
    both = features.join(lim, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = metric("mean_word") >= F.col("low_mean_word")
    for m in METRICS:
        inside = inside & (metric(m) <= F.col(f"top_{m}"))
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_lang", "_source")


def apply_rules(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; texts are measured once and never shuffled.

    Rows that pass the base rule are written with their counts, and judged when all counts are known. The explode keeps the filter
    behind the counts, which would be computed for it once more otherwise.
    """
    rows = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_row"))
    rows = with_features(rows)
    counts = [c for c in rows.columns if c not in ("text", "lang", "source", "_row")]
    rows = rows.select("lang", "source", "_row", F.explode(F.array(F.struct(*counts))).alias("_counts")).where("NOT _counts.base_failed")
    rows = keep(rows.select("lang", "source", "_row", "_counts.*"), "quality-features")
    limits = keep(bounds(sketch(rows.drop("_row"))), "quality-bounds")
    return judged(rows, limits).where("kept").select("_row.*")


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row."""
    features = keep(with_features(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-features")
    limits = keep(bounds(sketch(features)), "quality-bounds")
    return judged(features, limits)


__all__ = ["apply_rules", "bounds", "judge", "judged", "metric", "quartiles", "sketch", "with_features"]
