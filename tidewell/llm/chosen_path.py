"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct ``width``-word shingles (lower-cased ASCII), hashed to 64 bits; equal sets are one class. Each
class carries ``COORDINATES`` minwise tokens. In a tree, a node chooses a token, and a second one in ``SECOND`` of 256 nodes, and
sends every class to the children named by its own values: a pair with similarity s stays together in a child with
probability s, so pairs at the threshold survive as a branching process while others part quickly. A class follows 1.5 paths
a level, 3.4 in a tree of the first ``DEPTH`` levels. ``TREES`` independent trees bring the recall of a pair at the threshold to
``1 - 0.24^4``, 0.997; alike texts have more pairs than one.

Nodes of at most ``MOST_ROWS`` classes are compared exhaustively. The tokens split a node into clusters first: pairs whose 64 tokens
agree in fewer than the threshold's mean less ``DEVIATIONS`` standard deviations (35 at 0.8; one in 800,000 pairs at the threshold) are
taken for different. A cluster is named by its ids, so that the many nodes which hold the same texts are one group, and the
full sets of a group are compared (``groups.linked``); no false link remains, and links stay linear in the rows.

Larger nodes are first dealt into blocks that share some rows (``hub_blocks``), which links the bulk of a large group of copies. Those
that still hold several components branch on, level by level, with nodes of one component left out; what is larger than a task
at the deepest level is compared in blocks, all rows outside the largest component against all others.

Texts without words have the empty set and no links; a null text has no words. Fewer words than ``width`` form one shingle. Rows with
null doc_id link with nothing, keep a null component and are kept. Rows with equal doc_id count as one node. An empty table
gives an empty result. Only doc_id and text are read; extra columns pass through ``deduplicate`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import groups
from tidewell.llm.components import components
from tidewell.llm.scratch import drop, keep

WIDTH, PERCENT = 5, 80
COORDINATES, TREES, DEPTH, MOST_DEPTH, SECOND = 64, 4, 3, 10, 128
#: Standard deviations below the threshold's mean down to which tokens of a pair may agree.
DEVIATIONS = 5
#: Ids up to which their table is sent to every executor (8 bytes each) instead of shuffling the texts.
BROADCAST_IDS = 500_000
_U = np.uint64
_rng = np.random.default_rng(0xC0FFEE)
_MUL = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_XOR = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_CACHE = 200_000


def mix(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    count = len(h) - n + 1
    out = np.full(count, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[j : j + count])
    return np.unique(out)


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, 16 bits of it."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            best = np.minimum(best, ((s[i : i + 2048, None] ^ _XOR) * _MUL).min(0))
    return (mix(best) & _U(0xFFFF)).astype(np.uint16)


def _choose(node: np.ndarray, used: np.ndarray, which: int) -> np.ndarray:
    """A coordinate of each node that its path has not used: all classes of a node choose alike."""
    c = mix(node + _U(which * 0x51ED2701 + 1)) % _U(COORDINATES)
    while (taken := (used >> c) & _U(1)).any():
        c = (c + taken) % _U(COORDINATES)
    return c


def children(node: np.ndarray, used: np.ndarray, tokens: np.ndarray):
    """(rows, node, used) of the first and the second children of some rows' nodes; coordinates of a path do not repeat."""

    def child(rows, c, which):
        value = tokens[rows, c.astype(np.int64)].astype(np.uint64)
        with np.errstate(over="ignore"):
            name = mix(mix(node[rows] + c * _U(0xA24BAED4963EE407)) ^ (value * _U(0x9FB21C651E98DF25)) + _U(which))
        return rows, name, used[rows] | (_U(1) << c)

    rows = np.arange(len(node))
    first = _choose(node, used, 0)
    yield child(rows, first, 0)
    rows = np.flatnonzero((mix(node ^ _U(0x5EC0)) & _U(255)) < _U(SECOND))
    if len(rows):
        yield child(rows, _choose(node[rows], used[rows] | (_U(1) << first[rows]), 1), 1)


def paths(tokens: np.ndarray, trees: int, depth: int):
    """(rows, node, used) of the nodes at ``depth`` of every tree that some classes reach."""
    for tree in range(trees):
        level = [(np.arange(len(tokens)), np.full(len(tokens), mix(_U(tree + 1)), np.uint64), np.zeros(len(tokens), np.uint64))]
        for _ in range(depth):
            level = [(rows[at], name, now) for rows, node, used in level for at, name, now in children(node, used, tokens[rows])]
        yield from level


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COORDINATES)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def scan(docs: DataFrame, width: int, per_batch: int = 1000) -> DataFrame:
    """(doc_id, n_shingles, print, tokens) of every row; print names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, per_batch):
                batch = whole.slice(i, per_batch)
                sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "print": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "tokens": pa.array([minwise(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, tokens binary")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, members) of the documents in ``ids``: their texts are read again rather than every set being stored."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "members": pa.array([shingles(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())})

    return rows.mapInArrow(run, "id long, members binary")


def _names(key: np.ndarray, columns: list[pa.Array], rows: np.ndarray) -> list[pa.Array]:
    at = pa.array(rows)
    return [_signed(key), *[c.take(at) for c in columns]]


def roots(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(key, id, comp, n, near) of every class at its nodes; near has the low byte of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _tokens(batch.column(3))
            near = pa.array([x.tobytes() for x in t.astype(np.uint8)], pa.binary())
            for rows, node, _ in paths(t, trees, depth):
                yield pa.RecordBatch.from_arrays(_names(node, [*batch.columns[:3], near], rows), names=["key", "id", "comp", "n", "near"])

    return classes.select("id", F.col("id").alias("comp"), "n", "tokens").mapInArrow(run, "key long, id long, comp long, n long, near binary")


def branches(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(key, id, n, used, tokens): like ``roots``, with all that deeper levels need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, node, used in paths(_tokens(batch.column(2)), trees, depth):
                key, *rest = _names(node, list(batch.columns), rows)
                yield pa.RecordBatch.from_arrays([key, *rest[:2], _signed(used), rest[2]], names=["key", "id", "n", "used", "tokens"])

    return classes.select("id", "n", "tokens").mapInArrow(run, "key long, id long, n long, used long, tokens binary")


def deeper(rows: DataFrame) -> DataFrame:
    """The rows of ``branches`` one level down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, used = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 3))
            for at, name, now in children(node, used, _tokens(batch.column(4))):
                key, ids, n, tokens = _names(name, [batch.column(1), batch.column(2), batch.column(4)], at)
                yield pa.RecordBatch.from_arrays([key, ids, n, _signed(now), tokens], names=["key", "id", "n", "used", "tokens"])

    return rows.mapInArrow(run, "key long, id long, n long, used long, tokens binary")


def nearer(rows: DataFrame) -> DataFrame:
    """(key, id, comp, n, near) of (key, id, comp, n, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array([x.tobytes() for x in _tokens(batch.column(4)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], near], names=["key", "id", "comp", "n", "near"])

    return rows.select("key", "id", "comp", "n", "tokens").mapInArrow(run, "key long, id long, comp long, n long, near binary")


def agree(percent: int, deviations: int = DEVIATIONS) -> int:
    """Least number of equal tokens for a comparison on full sets: some standard deviations below the threshold's mean."""
    s = percent / 100
    return max(1, int(COORDINATES * s - deviations * (COORDINATES * s * (1 - s)) ** 0.5))


def node_clusters(ids, comp, n, near, percent: int) -> list[np.ndarray]:
    """Places of the rows of a node, by clusters of likely pairs that hold several components."""
    k, least = len(ids), agree(percent)
    near = near.reshape(k, COORDINATES)
    likely = np.zeros((k, k), bool)
    for i in range(0, k, 64):
        likely[i : i + 64] = (near[i : i + 64, None] == near[None]).sum(2, dtype=np.uint8) >= least
    likely &= 100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None])
    out, left = [], np.ones(k, bool)
    for start in range(k):
        if left[start]:
            left[start], inside, edge = False, [np.array([start])], np.array([start])
            while len(edge := np.flatnonzero(likely[edge].any(0) & left)):
                left[edge] = False
                inside.append(edge)
            inside = np.sort(np.concatenate(inside))
            if len(np.unique(comp[inside])) > 1:
                out.append(inside)
    return out


def clusters(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (gid, id) of the clusters in the nodes of ``rows`` (key, id, comp, n, near); nodes fit in a task."""
    least = agree(percent)

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        near = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        return [*(batch.column(i).to_numpy() for i in range(4)), near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, comp, n, near in groups.whole_keys(batches, columns):
            at = groups.runs(key)
            size, found = np.diff(at), []
            # Most nodes have two classes: all of them at once.
            i = at[:-1][size == 2]
            j = i + 1
            ok = ((near[i] == near[j]).sum(1) >= least) & (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            found += [np.sort(ids[[x, x + 1]]) for x in i[ok]]
            for x, y in zip(at[:-1][size > 2], at[1:][size > 2], strict=True):
                for inside in node_clusters(ids[x:y], comp[x:y], n[x:y], near[x:y], percent):
                    by_id = x + inside[np.argsort(ids[x + inside], kind="stable")]
                    found += groups.chunks(ids[by_id], n[by_id])
            if found:
                gids = [groups.group_id(g) for g in found]
                yield pa.RecordBatch.from_pydict({"gid": pa.array(np.repeat(np.array(gids, np.int64), [len(g) for g in found])), "id": pa.array(np.concatenate(found))})

    dealt = rows.select("key", "id", "comp", "n", "near").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "gid long, id long").distinct()


def links(rows: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within the nodes of ``rows``, confirmed on full sets."""
    found = keep(clusters(rows, percent), "clusters")
    out = keep(groups.linked(found, sets_of(docs, found.select("id").distinct(), width), percent), "links")
    drop(found)
    return out


def placed(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """``classes`` with ``comp``, the component known so far."""
    return classes.drop("comp").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def search(classes: DataFrame, docs: DataFrame, width: int, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, most: int = groups.MOST_ROWS, deepest: int = MOST_DEPTH) -> DataFrame:
    """Confirmed links (a, b) between classes (id, n, tokens): enough of them to connect whatever is connected."""
    columns = ["key", "id", "comp", "n", "near"]
    rows = roots(classes, trees, depth)
    large = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most), "large-nodes")
    if large.isEmpty():
        return links(rows, docs, width, percent)
    small = rows.join(large, "key", "left_anti")
    found = links(small.union(groups.hub_blocks(rows.join(large, "key"), most).select(*columns)), docs, width, percent)
    comp = components(found)
    nodes = keep(branches(classes, trees, depth).join(large.select("key"), "key", "left_semi"), "branches")
    leaves = []
    while True:
        rows = placed(nodes, comp)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        sizes = keep(sizes.select("key", "c"), "mixed-nodes")
        rows = rows.join(sizes, "key")
        leaves.append(rows.where(F.col("c") <= most).select("key", "id", "comp", "n", "tokens"))
        large = rows.where(F.col("c") > most)
        if depth >= deepest:
            leaves.append(groups.outsider_blocks(large.select("key", "id", "comp", "n", "tokens"), most))
            break
        if sizes.where(F.col("c") > most).isEmpty():
            break
        nodes, depth = keep(deeper(large.select("key", "id", "n", "used", "tokens")), "branches"), depth + 1
    rest = leaves[0]
    for leaf in leaves[1:]:
        rest = rest.union(leaf)
    return found.union(links(nearer(rest), docs, width, percent))


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = keep(scan(docs, width), "shingled")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # The group of a print has one value of tokens and n_shingles, so max takes it.
    classes = keep(named.groupBy("print").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("tokens").alias("tokens")), "classes")
    found = keep(search(classes, docs, width, percent, **options).distinct(), "all-links")
    comp = components(found)
    first = classes.select("print", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("print", F.coalesce("root", "id").alias("root"))
    out = rows.select("doc_id", "n_shingles", "print").join(first, "print", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("root")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component. The removed ids are joined; texts are only shuffled where they are many."""
    gone = keep(link(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    # The row is carried whole, so that its columns cannot clash.
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*docs.columns).alias("_row"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
