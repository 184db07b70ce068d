import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing, quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_counts_equal_brute_force(spark):
    texts = [None, "", " ", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "é# 日本 a|b\x0b\x0cc\r\nd", "a b c d a b c", "a b\nc\na b\nc", "\x85   a", " lead trail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.with_features(df).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_verdicts(docs, rows, none):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for d, t, *_ in rows:
        if d is None:
            continue
        n, *_, rep = brute(t)
        assert by[d].base_failed == (n < 50 or 100 * rep > 50 * n) and not (by[d].base_failed and by[d].kept)
        if "%%%" in (t or ""):
            assert not by[d].kept
        elif n >= 60 and rep == 0:
            assert by[d].kept, (d, t[:40])
    out = quality.apply_rules(docs)
    assert out.columns == docs.columns and out.count() == sum(r.kept for r in got) and {r.kept for r in out.collect()} <= {"k", None}
    assert quality.judge(none).isEmpty() and quality.apply_rules(none).isEmpty()


def test_sketches_merge_and_bound_quantiles(spark):
    values = [i / 997 for i in range(1, 998)]
    df = spark.createDataFrame([("en", "s", False, 1000, round(1000 * v), i % 2) for i, v in enumerate(values)], "lang string, source string, base_failed boolean, word_chars long, n_symbols long, half int")
    df = df.withColumns({"n_capitals": F.lit(0), "n_repeat_words": F.lit(0), "n_words": F.lit(10), "n_dup_lines": F.lit(0), "n_lines": F.lit(1)})
    whole = quality.sketch(df)
    halves = quality.sketch(df.where("half = 0")).union(quality.sketch(df.where("half = 1")))
    a, b = (sorted(quality.quartiles(s, ["lang", "source"]).collect()) for s in (whole, halves))
    assert a == b
    r = next(x for x in a if x.metric == "symbol_ratio")
    exact = sorted(round(1000 * v) / 1000 for v in values)
    assert r.q1 == pytest.approx(exact[249], rel=0.021) and r.q3 == pytest.approx(exact[747], rel=0.021)


def test_bounds_hold_in_sources_full_of_junk(spark):
    """Sources of which up to 49 % are junk of one kind lose the junk, all of it below the base rule, and keep the rest."""
    kinds = {"n_symbols": 300, "n_capitals": 150, "n_repeat_words": 90, "n_dup_lines": 18, "long": 3000, "short": 200}
    data = []
    for kind, bad in kinds.items():
        for junk in (1, 60, 80, 98):
            for i in range(200):
                row = {"n_words": 200, "word_chars": 960 + i % 80, "n_symbols": i % 3, "n_capitals": 14 + i % 8, "n_repeat_words": i % 5, "n_dup_lines": 0, "n_lines": 40}
                if i < junk:
                    row["word_chars" if kind in ("long", "short") else kind] = bad + i % 7 * (bad > 100)
                data.append(("en", f"{kind}-{junk}", False, i < junk, *row.values()))
    features = spark.createDataFrame(data, "lang string, source string, base_failed boolean, junk boolean, n_words long, word_chars long, n_symbols long, n_capitals long, n_repeat_words long, n_dup_lines long, n_lines long")
    got = quality.judged(features, quality.bounds(quality.sketch(features))).groupBy("source", "junk").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {(r.source, r.junk): r.kept for r in got} == {(f"{k}-{n}", j): 0.0 if j else 1.0 for k in kinds for n in (1, 60, 80, 98) for j in (True, False)}


def level(sizes, weights):
    """Targets by repeated sharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: share * w[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix(docs, rows, none):
    got = mixing.digest(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += words(t)
    want, source = level(sizes, (5, 2, 1)), {d: s for d, _, _, s, *_ in rows}
    taken, most = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert len(r.shards) == r.copies and all(0 <= x < 2**mixing.LEAST_LEVELS for x in r.shards)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in sizes)
    again = sorted(map(str, mixing.digest(docs.repartition(3)).collect()))
    assert again == sorted(map(str, got))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and {(r.draws, r.key, r.size) for r in mixed.collect()} <= {("d", "y", "z"), (None, None, None)}
    copies = Counter(r.doc_id for r in mixed.collect())
    drawn = Counter()
    for r in got:
        drawn[r.doc_id] += r.copies
    assert copies == +drawn
    assert mixing.digest(none).isEmpty() and mixing.mixed_rows(none).isEmpty()


def test_targets_in_closed_form(spark):
    for case in ({"a": 100, "b": 1, "c": 50, "d": 0, None: 7}, {"a": 5}, {"a": 0}, {f"s{i}": (i * 37) % 91 + 1 for i in range(20)}, {"a": 1, "b": 1000, "c": 1}):
        df = spark.createDataFrame([(k, v) for k, v in case.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(level(case, (5, 2, 1)))


def test_tree_splits_quotas_exactly(spark):
    goals = spark.createDataFrame([("a", 100, 300.0), ("b", 100, 100.0)], "source string, source_size long, target double")
    blocks = mixing.block_shards(goals, seed=1, levels=3, blocks=400)
    shards = Counter(x for r in blocks.collect() for x in r.shards)
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 8
    other = mixing.block_shards(goals, seed=2, levels=3, blocks=400)
    assert sorted(map(str, other.collect())) != sorted(map(str, blocks.collect()))

