import itertools
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tidewell.llm import chosen_path, fuzzy_lines, groups
from tidewell.llm.components import components
from tidewell.llm.groups import alike


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 450)] + [(7, 7)]
    want = roots(460, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_long_chains_take_few_rounds(spark):
    """In any order of their ids."""
    rng = np.random.default_rng(4)
    order = rng.permutation(600) + 1000
    edges = [(i, i + 1) for i in range(600)] + [(int(order[i]), int(order[i + 1])) for i in range(599)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(601), 0), **dict.fromkeys(range(1000, 1600), 1000)}


def some_sets(rng, n):
    base = rng.integers(0, 2**62, 100)
    return [np.unique(np.concatenate([base[: rng.integers(60, 100)], rng.integers(0, 2**62, rng.integers(0, 20))])).astype("<u8") for _ in range(n)]


def test_linked_connects_what_is_alike(spark):
    rng = np.random.default_rng(5)
    sets = [*some_sets(rng, 30), np.zeros(0, "<u8"), *some_sets(rng, 12)]
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, members binary")
    members = [(1, i) for i in range(31)] + [(2, i) for i in range(31, 43)] + [(3, 0), (3, 30), (4, 5)]
    got = [(r.a, r.b) for r in groups.linked(spark.createDataFrame(members, "gid long, id long"), df, 80).collect()]
    true = {(a, b) for a, b in itertools.combinations(range(43), 2) if (u := len(set(sets[a]) | set(sets[b]))) and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * u}
    want = roots(43, [(a, b) for a, b in true if (a < 31) == (b < 31)])
    assert set(got) <= true and roots(43, got) == want and len(got) < 43 and 2 < len(set(want)) < 43
    assert not alike(sets[30], sets[30], 80)


def test_chunks_cover_every_pair(monkeypatch):
    monkeypatch.setattr(groups, "MOST_MEMBERS", 100)
    rng = np.random.default_rng(6)
    ids, sizes = np.arange(40), rng.integers(1, 30, 40)
    found = groups.chunks(ids, sizes)
    assert {p for g in found for p in itertools.combinations(g.tolist(), 2)} == set(itertools.combinations(range(40), 2))
    assert all(sizes[g].sum() <= 100 + 2 * 30 for g in found)
    assert [x.tolist() for x in groups.chunks(ids[:2], np.array([1000, 2000]))] == [[0, 1]]


def test_outsider_blocks_leave_no_pair_out(spark):
    rng = np.random.default_rng(8)
    rows = [(k, 1000 * k + i, int(c)) for k, n in ((1, 300), (2, 40), (3, 2), (4, 5)) for i, c in enumerate(rng.choice([1, 1, 1, 1, 2, 3], n) if k < 4 else [9] * n)]
    out = groups.outsider_blocks(spark.createDataFrame(rows, "key long, id long, comp long"), 32).collect()
    per = {}
    for r in out:
        per.setdefault(r.key, set()).add(r.id)
    met = {p for g in per.values() for p in itertools.combinations(sorted(g), 2)}
    assert {(x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[2] != y[2]} <= met
    assert max(map(len, per.values())) < 80 and len(out) == len({(r.key, r.id) for r in out})


def test_hub_blocks_share_rows(spark):
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("key"), "id", F.lit(1000).alias("c"))
    per = {}
    for r in groups.hub_blocks(rows, 200).collect():
        per.setdefault(r.key, set()).add(r.id)
    hubs = set.intersection(*per.values())
    assert len(per) == 10 and set.union(*per.values()) == set(range(1000)) and 20 < len(hubs) < 80 and max(map(len, per.values())) < 250


def brute_docs(rows, width):
    """component per (doc_id, text) by comparing all pairs."""
    live = [(d, chosen_path.shingles(t, width)) for d, t, *_ in rows if d is not None]
    live = [(d, s) for d, s in live if len(s)]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(live, 2) if alike(x, y, 80)]
    return roots(max(r[0] for r in rows if r[0] is not None) + 1, links)


@pytest.mark.parametrize(("width", "options"), [(2, {}), (5, {"most": 16, "deepest": 5}), (2, {"most": 8, "deepest": 3})])
def test_link_equals_brute_force(docs, rows, width, options, monkeypatch):
    if options:
        monkeypatch.setattr(groups, "HUBS", 2)
        monkeypatch.setattr(groups, "MOST_MEMBERS", 2000)
        monkeypatch.setattr(chosen_path, "BROADCAST_IDS", 0)
    want = brute_docs(rows, width)
    got = chosen_path.link(docs, width=width, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = {r.doc_id: r.n_shingles for r in got if r.doc_id is not None}
    assert all(sizes[d] == len(chosen_path.shingles(t, width)) for d, t, *_ in rows if d is not None)


def test_shingles_are_the_contracts():
    count = lambda t, w: len(chosen_path.shingles(t, w))
    assert [count(t, 2) for t in (None, "", " \n", "a", "a b", "a b a b", "A b a B")] == [0, 0, 0, 1, 1, 2, 2]
    assert (chosen_path.shingles("X Y", 5) == chosen_path.shingles("x\ty", 5)).all() and (chosen_path.shingles("É", 2) != chosen_path.shingles("é", 2)).all()


def test_deduplicate_keeps_columns_and_clean_rows(docs, none, rows):
    out = chosen_path.deduplicate(docs)
    assert out.columns == docs.columns
    want = brute_docs(rows, 5)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(d for d, *_ in rows if d is not None and want[d] == d)
    assert chosen_path.link(none).isEmpty() and chosen_path.deduplicate(none).isEmpty()


CLASHING = ["_gone", "_id", "_row", "_doc", "_version", "_own_doc", "_text", "gone", "doc", "version", "line", "h", "key", "root", "comp"]


@pytest.mark.parametrize("f", [chosen_path.deduplicate, fuzzy_lines.deduplicate])
def test_extra_columns_of_any_name_pass_through(spark, docs, f):
    wide = docs.select("doc_id", "text", *[F.col("doc_id").alias(c) for c in CLASHING])
    got = f(wide)
    assert got.columns == wide.columns
    assert all(r[c] == r.doc_id for r in got.collect() for c in CLASHING)


def version(text):
    """Spark's hash of a text, which orders the documents that share a doc_id."""
    return 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(text.encode(), 42) >> 63)


def brute_lines(rows):
    """(doc_id, version, line number) of the lines that stay."""
    occ = sorted({(d is None, d or 0, version(t), i, x) for d, t, *_ in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")})
    texts = list(dict.fromkeys(x for *_, x in occ))
    sets = [fuzzy_lines.line_set(x.encode()) for x in texts]
    root = roots(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if alike(sets[a], sets[b], 80)])
    at, first = {x: i for i, x in enumerate(texts)}, {}
    for *place, x in occ:
        first.setdefault(root[at[x]], place)
    return {(None if late else d, v, i) for late, d, v, i, x in occ if first[root[at[x]]] == [late, d, v, i]}


@pytest.mark.parametrize("most", [2048, 4])
def test_lines_equal_brute_force(spark, docs, rows, most, monkeypatch):
    if most < 100:
        monkeypatch.setattr(fuzzy_lines.line_components, "__defaults__", (80, most))
        monkeypatch.setattr(groups, "HUBS", 1)
        monkeypatch.setattr(fuzzy_lines, "BROADCAST_LINES", 0)
    more = [(None, rows[0][1], *[None] * 7), (None, "alone without an id\n" + (rows[1][1] or ""), *[None] * 7), (2**63 - 1, "the last id there is\nalone without an id", *[None] * 7)]
    all_rows = [*rows, *more]
    docs = spark.createDataFrame(all_rows, docs.schema)
    want = brute_lines(all_rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.kept_lines) for r in fuzzy_lines.digest(docs).collect())
    words = lambda t: [i for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
    assert got == sorted((d is None, d or 0, len(words(t)), [i for i in words(t) if (d, version(t), i) in want]) for d, t, *_ in all_rows)
    assert all(r.n_kept == len(r.kept_lines) for r in fuzzy_lines.digest(docs).collect())
    out = fuzzy_lines.deduplicate(docs)
    assert out.columns == docs.columns
    expected = []
    for d, t, *_ in all_rows:
        left = [x for i, x in enumerate((t or "").split("\n")) if i not in words(t) or (d, version(t), i) in want]
        if not words(t) or any((d, version(t), i) in want for i in words(t)):
            expected.append((d is None, d or 0, "" if t is None else "\n".join(left), t is None))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in out.collect()) == sorted(expected)


def test_bands_reach_their_recall():
    """Pairs of sets at the threshold share a band as often as the docstring says."""
    rng = np.random.default_rng(2)
    lost = 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 90, dtype=np.uint64)
        y = np.concatenate([x[:80], rng.integers(0, 2**63, 10, dtype=np.uint64)])
        keys = fuzzy_lines.bands(np.concatenate([x, y]), np.array([0, 90]))
        lost += not (keys[0] == keys[1]).any()
    assert lost <= 16


def test_lines_of_empty_table(none):
    assert fuzzy_lines.digest(none).isEmpty() and fuzzy_lines.deduplicate(none).isEmpty()


def test_crowded_bands_are_found(spark):
    rows = spark.createDataFrame([([i % 3, 10 + i],) for i in range(60)], "keys array<long>").coalesce(2)
    assert sorted((r.key, r.c) for r in fuzzy_lines.crowded(rows, 19).collect()) == [(0, 20), (1, 20), (2, 20)]


@pytest.mark.parametrize("few", [["a"], [" lead", "abcde"], ["É ", "日本語テキスト"]])
def test_many_lines_are_hashed_as_one_by_one(few):
    odd = ["a", "ab", " a b ", "x\t\ty  z ", "trail ", "a\x1cb  c\xa0 d", "  ", "\r", "abcd", "AbCdE\x0bf", "\U0001f600 ok", "\x00 null  ", "again and again " * 9000]
    for lines in (few, [*few, *odd], [*odd * 3, *few]):
        sets = fuzzy_lines.line_sets([x.encode() for x in lines])
        assert len(sets) == len(lines) and all(np.array_equal(x, fuzzy_lines.line_set(t.encode())) for x, t in zip(sets, lines, strict=True))


def test_bands_travel_packed(spark, monkeypatch):
    """A few packed rows hold every key of every line, with the keys left out that are dealt in blocks."""
    monkeypatch.setattr(fuzzy_lines, "_PACKED", 300)
    data = [([i % 50, 1000 + i, 7], i, 10 + i % 3) for i in range(200)]
    rows = spark.createDataFrame(data, "keys array<long>, id long, n int").coalesce(2)
    got = fuzzy_lines.packed(rows, 500_000, np.array([7])).collect()
    assert len(got) <= 6 * 4
    held = [r for x in got for r in np.frombuffer(bytes(x.rows), fuzzy_lines._ROW).tolist()]
    assert sorted(held) == sorted((k, i, n) for keys, i, n in data for k in keys if k != 7)
    groups_of = fuzzy_lines.band_groups(fuzzy_lines.packed(rows, 600)).groupBy("gid").count().collect()
    assert sorted(r["count"] for r in groups_of) == [4] * 49 + [200]


def test_crowded_bands_are_left_to_blocks(spark, monkeypatch):
    """Keys of crowded bands that are sent to the packing tasks: nothing is lost, with few documents."""
    monkeypatch.setattr(fuzzy_lines.line_components, "__defaults__", (80, 4))
    monkeypatch.setattr(groups, "HUBS", 1)
    words = "one line of the corpus that has nearly the same words in every copy of it there is"
    rows = [(i, f"{words} {i}\nalone {i} {'xyz' * i} {i * i}\n{words.upper()}") for i in range(12)]
    want = brute_lines(rows)
    got = fuzzy_lines.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, version(rows[r.doc_id][1]), n) for r in got for n in r.kept_lines} == want and len(want) < 20


def test_nodes_compare_pairs_whose_tokens_agree_little(spark):
    """At the threshold, fewer pairs are lost to the token filter than to all trees."""
    lost = sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(chosen_path.agree(80)))
    assert lost < 0.06**4
    a, b, c = bytearray(64), bytearray([0] * 36 + [1] * 28), bytearray([0] * 30 + [2] * 34)
    rows = [(1, i, i, 100, t) for i, t in ((1, a), (2, b))] + [(2, i, i, 100, t) for i, t in ((1, a), (2, b), (3, c))] + [(3, 1, 1, 100, a), (3, 2, 1, 100, b)]
    found = chosen_path.clusters(spark.createDataFrame(rows, "key long, id long, comp long, n long, near binary"), 80).collect()
    assert sorted(r.id for r in found) == [1, 2] and len({r.gid for r in found}) == 1


def test_pairs_at_the_threshold_meet():
    """Trees bring alike token rows together as often as the docstring says: 0.9 at the least."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2**16, (500, 64)).astype("<u2")
    y = np.where(rng.random((500, 64)) < 0.8, x, rng.integers(0, 2**16, (500, 64))).astype("<u2")
    met = np.zeros(500, bool)
    for rows, node, _ in chosen_path.paths(np.concatenate([x, y]), chosen_path.TREES, chosen_path.DEPTH):
        a, b = {}, {}
        for r, k in zip(rows.tolist(), node.tolist(), strict=True):
            (a if r < 500 else b).setdefault(r % 500, set()).add(k)
        for r in a:
            met[r] |= bool(a[r] & b.get(r, set()))
    assert met.mean() > 0.98
