"""Exhaustive comparison of sets within bounded groups, on their full members.

``linked`` takes (gid, id) rows and a set per id, deals them by gid, and compares the sets of a group with each other: breadth first,
each set against those that nothing has reached yet. It returns the links of a forest that connects whatever is connected in a
group, at most one fewer than the group has sets, so that its rows stay linear however alike a group is.

``chunks`` cuts a group whose sets are too large for one task into groups of two chunks each, which cover every pair.
``hub_blocks`` and ``outsider_blocks`` deal the rows of keys that hold too many for one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that are compared in one task; set members of a group (8 bytes each); rows of a large key that all its blocks hold.
MOST_ROWS, MOST_MEMBERS, HUBS = 2048, 4_000_000, 48
#: Bytes of members whose sets are made together.
AT_ONCE = 256_000


def stored(members: bytes) -> np.ndarray:
    """A set kept as sorted distinct 64-bit values, little-endian."""
    return np.frombuffer(members, "<u8")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct arrays reach the similarity; empty sets never do."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect whatever the similarity connects, found breadth first."""
    k = len(sets)
    if k == 2:
        return [(0, 1)] if alike(*sets, percent) else []
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, owner = flat.astype(np.int32), np.repeat(np.arange(k, dtype=np.int32), sizes)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    mark, open_, out = np.zeros(len(values), bool), np.ones(k, bool), []
    for start in range(k):
        queue = [start] if open_[start] else []
        open_[start] = False
        while queue and len(flat):
            x = queue.pop()
            left = open_[owner]
            flat, owner = flat[left], owner[left]
            mark[own[x]] = True
            same = np.bincount(owner[mark[flat]], minlength=k)
            mark[own[x]] = False
            found = np.flatnonzero(open_ & (same > 0) & (100 * same >= percent * (sizes + sizes[x] - same)))
            open_[found] = False
            out += [(x, int(y)) for y in found]
            queue += found.tolist()
    return out


def chunks(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``ids`` as one group, or as groups of two chunks of at most half of ``MOST_MEMBERS`` where they can be cut so."""
    if sizes.sum() <= MOST_MEMBERS:
        return [ids]
    part = np.cumsum(sizes) * 2 // MOST_MEMBERS
    parts = [ids[part == p] for p in np.unique(part)]
    return [np.concatenate([x, y]) for i, x in enumerate(parts) for y in parts[i + 1 :]] or [ids]


def group_id(ids: np.ndarray) -> int:
    """The name of a group of sorted ids: equal groups of several nodes are compared once."""
    return xxhash.xxh3_64_intdigest(ids.tobytes()) - 2**63


def runs(key: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)


def whole_keys(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that each key (the first column) is in one piece."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        if held and held[-1][0][-1] == now[0][-1]:
            held.append(now)
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        whole = [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True)]
        if len(whole[0]):
            yield whole
        held = [[x[cut:] for x in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def pairs_of(rows: list[tuple[int, bytes]], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    links = forest(sets, percent) if len(rows) > 1 else []
    return [(min(a, b), max(a, b)) for i, j in links if (a := rows[i][0]) != (b := rows[j][0])]


def linked(groups: DataFrame, sets: DataFrame, percent: int, to_set: Callable[[bytes], np.ndarray] = stored, to_sets: Callable[[list[bytes]], list[np.ndarray]] | None = None) -> DataFrame:
    """Links (a, b) between ids of a group (gid, id) whose sets have ``100 * intersection >= percent * union``.

    ``sets`` has (id, members); ``to_set`` makes sorted distinct values of members, which are what travels: the values
    themselves, or a text where that is shorter than its set; ``to_sets`` does so for those of several groups at a time. Ids may
    have several sets; any may match.
    """
    dealt = groups.join(sets, "id").select("gid", "id", "members").repartition("gid").sortWithinPartitions("gid")

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        members = np.empty(batch.num_rows, object)
        members[:] = batch.column(2).to_pylist()
        return [batch.column(0).to_numpy(), batch.column(1).to_numpy(), members]

    def with_sets(own: Iterator[list[tuple[int, bytes]]]) -> Iterator[tuple[list[tuple[int, bytes]], list[np.ndarray]]]:
        """Each group's rows and their sets, made for groups of about ``AT_ONCE`` bytes together."""
        held, size = [], 0

        def made():
            texts = list(dict.fromkeys(m for rows in held for _, m in rows))
            sets = dict(zip(texts, to_sets(texts) if to_sets else map(to_set, texts), strict=True))
            return [(rows, [sets[m] for _, m in rows]) for rows in held]

        for rows in own:
            held.append(rows)
            size += sum(len(m) for _, m in rows)
            if size > AT_ONCE:
                yield from made()
                held, size = [], 0
        if held:
            yield from made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gid, ids, members in whole_keys(batches, columns):
            at = runs(gid)
            own = (list(dict.fromkeys(zip(ids[i:j].tolist(), members[i:j].tolist(), strict=True))) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            found = dict.fromkeys(p for rows, sets in with_sets(own) for p in pairs_of(rows, sets, percent))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return dealt.mapInArrow(run, "a long, b long")


def _block(what: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(what), F.col("id")), blocks).cast("int")


def hub_blocks(large: DataFrame, most: int) -> DataFrame:
    """Rows of large keys (key, id, ..., c rows in the key) dealt by hash into blocks that fit in a task, in the place of their key.

    About ``HUBS`` rows of a key are in all its blocks: what is alike to one of them meets it wherever it is.
    """
    blocks = F.ceil(F.col("c") / (most - 2 * min(HUBS, most // 4))).cast("int")
    hub = F.pmod(F.xxhash64(F.lit("hub"), F.col("id")), F.col("c")) < min(HUBS, most // 4)
    rows = large.withColumn("_blocks", blocks)
    rows = rows.withColumn("_block", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(_block("own", F.col("_blocks"))))))
    return rows.withColumn("key", F.xxhash64("key", "_block")).drop("_blocks", "_block")


def outsider_blocks(large: DataFrame, most: int) -> DataFrame:
    """Rows of large keys (key, id, comp, ...) dealt so that every row outside its key's largest component meets all other rows.

    Outsiders are dealt into blocks of ``most / 2`` rows, all rows likewise, and every pair of such blocks is a key of its own; a
    key with one block of outsiders costs as much as it has rows.
    """
    per = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("_all"))
    half = max(1, most // 2)
    top = top.select("key", F.col("top")["comp"].alias("_major"), F.ceil(F.col("_all") / half).cast("int").alias("_p"), F.ceil((F.col("_all") - F.col("top")["n"]) / half).cast("int").alias("_q")).where("_q > 0")
    rows = large.join(top, "key")
    as_any = F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda i: F.struct(i.alias("i"), _block("any", F.col("_p")).alias("j")))
    as_out = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda j: F.struct(_block("out", F.col("_q")).alias("i"), j.alias("j")))
    pairs = F.when(F.col("comp") == F.col("_major"), as_any).otherwise(F.array_distinct(F.concat(as_any, as_out)))
    rows = rows.withColumn("_pair", F.explode(pairs))
    return rows.withColumn("key", F.xxhash64("key", F.col("_pair.i"), F.col("_pair.j"))).select(*large.columns)
