"""Fuzzy line dedup by MinHash: one line of each group of alike lines stays in a corpus.

A line (between line feeds, with a word in it) is normalised by lower-casing ASCII and collapsing white space; its set has the
distinct ``SHINGLE``-character shingles. Signatures have ``BANDS`` bands of ``ROWS`` minwise values; lines that share a band are
candidates (recall 98.6 % at a similarity of 0.8, 99.9 % at 0.85 per pair). The lines of a band, cut where set sizes differ too
much, are a group named by its lines, so that bands which hold the same lines are compared once, on the full sets
(``groups.linked``); distributed union-find makes components. The first occurrence of a component stays: the smallest doc_id, then
line number; null doc_ids come last.

Equal lines share a 64-bit hash and are one node. Bands of more lines than fit in a task are dealt into blocks that share some
lines, which links the bulk of them; if several components remain, those outside the largest meet all others in blocks. Such
bands are found from the keys that occur twice within a task; what stays below that is at most a row of each task.

Lines without a word are never removed and never compared. Null text has no lines. A document is a doc_id with a text: rows equal in
both go alike, several texts of one doc_id (or of none) are separate documents, in the order of their hashes. A document that
loses all its lines is dropped by ``deduplicate``; documents without any line with a word stay. Empty tables give empty results;
extra columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import groups
from tidewell.llm.components import components
from tidewell.llm.scratch import drop, keep
from tidewell.llm.words import SEPARATORS

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 14, 6
BROADCAST_LINES = 500_000
_rng = np.random.default_rng(0x11E5)
_MUL = _rng.integers(0, 2**31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Lines that a task remembers, to give each once; characters that are hashed at a time.
_SEEN, _AT_ONCE = 2_000_000, 64_000
#: Rows of bands that travel together on average, and those that a task packs at a time.
_BUCKET, _PACKED = 100_000, 500_000
_ROW = np.dtype([("key", "<i8"), ("id", "<i8"), ("n", "<i4")])
_SPACES = bytes.maketrans(b"\t\r\x0b\x0c", b"    ")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def normal(line: str) -> str:
    return b" ".join(line.encode().lower().split()).decode()


def shingled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of normalised lines, one line after the other, and where each line starts.

    A line shorter than a shingle is one shingle; it is filled up with a code that no text has.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if (size < SHINGLE).any():
        texts = [t.ljust(SHINGLE, "\n") for t in texts]
        size = np.maximum(size, SHINGLE)
    # Normalised lines have no line feed, so that one stands between them.
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    end = np.cumsum(size + 1) - 1
    filled = np.flatnonzero(codes == 10)
    if len(filled) >= len(texts):
        codes[np.setdiff1d(filled, end)] = 0xFFFFFFFF
    return _hashes(codes, end, size)


def _hashes(codes: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines that end at ``end``, a code before the next one begins."""
    out = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += codes[j : j + len(out)]
    inside = np.ones(len(out), bool)
    inside[(end[:-1, None] + np.arange(1 - SHINGLE, 1)).ravel()] = False
    count = size - SHINGLE + 1
    return _mix(out[inside]), np.cumsum(count) - count


def shingled_lines(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``shingled`` of lines as they are, normalised together; none has a line feed in it."""
    joined = b"\n".join(lines).lower().translate(_SPACES)
    if b"  " in joined or b" \n" in joined or b"\n " in joined or joined[:1] == b" " or joined[-1:] == b" ":
        joined = b"\n".join([b" ".join(x.split()) for x in joined.split(b"\n")])
    codes = np.frombuffer(joined, np.uint8) if joined.isascii() else np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
    end = np.append(np.flatnonzero(codes == 10), len(codes))
    size = np.diff(end, prepend=-1) - 1
    if (size < SHINGLE).any():
        return shingled(joined.decode().split("\n"))
    return _hashes(codes.astype(np.uint64), end, size)


def _pieces(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of lines of about ``_AT_ONCE`` bytes together."""
    i = 0
    while i < len(lines):
        j, size = i, 0
        while j < len(lines) and size < _AT_ONCE:
            size, j = size + len(lines[j]), j + 1
        yield i, j
        i = j


def line_set(line: bytes) -> np.ndarray:
    """Sorted distinct shingles of a line."""
    return np.unique(shingled([normal(line.decode())])[0])


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    """``line_set`` of each line, without the cost of a dozen calls for each."""
    out = []
    for i, j in _pieces(lines):
        hashes, start = shingled_lines(lines[i:j])
        for x, y in zip(start.tolist(), [*start[1:].tolist(), len(hashes)], strict=True):
            hashes[x:y].sort()
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        first[start] = True
        out += np.split(hashes[first], np.cumsum(np.add.reduceat(first, start, dtype=np.int64))[:-1])
    return out


def bands(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit key per line and band.

    A row orders the shingles by their products with an odd number, which is the product of those of all rows so far.
    """
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((BANDS * ROWS, len(start)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            np.multiply(x, _MUL[k], out=x)
            np.minimum.reduceat(x, start, out=least[k])
        out = (least.reshape(BANDS, ROWS, -1) * _FOLD[:, None]).sum(1, dtype=np.uint64).T
        return np.ascontiguousarray(_mix(out * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def document() -> list[Column]:
    """What names a document: its doc_id, and a hash of its text."""
    return [F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, version, line_no, line, h) of every line with a word, numbered among all lines of its document."""
    rows = docs.select(*document(), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line", F.lit(SEPARATORS.replace("\n", ""))) != "").withColumn("h", line_hash(F.col("line")))


def signed(lines: DataFrame) -> DataFrame:
    """(doc, version, line_no, h, n, keys) of each line: n shingles and its band keys, both null where its task gave them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = np.zeros(batch.num_rows, bool)
            for i, h in enumerate(batch.column(3).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    fresh[i] = True
            if len(seen) > _SEEN:
                seen.clear()
            texts = batch.column(4).filter(pa.array(fresh)).to_pylist()
            keys, n = np.empty((len(texts), BANDS), np.int64), np.zeros(batch.num_rows, np.int32)
            counts = []
            for i, j in _pieces(texts):
                hashes, start = shingled_lines(texts[i:j])
                keys[i:j] = bands(hashes, start)
                counts.append(np.diff(start, append=len(hashes)))
            if texts:
                n[fresh] = np.concatenate(counts)
            offsets = np.append(0, np.cumsum(fresh) * BANDS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()), mask=pa.array(~fresh))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, mask=~fresh), lists], names=["doc", "version", "line_no", "h", "n", "keys"])

    rows = lines.select("doc", "version", "line_no", "h", F.col("line").cast("binary"))
    return rows.mapInArrow(run, "doc long, version long, line_no int, h long, n int, keys array<long>")


def crowded(lines: DataFrame, most: int) -> DataFrame:
    """(key, c) of the bands that hold more rows than fit in a task, from the keys that a task has twice at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1]), pa.array(n[n > 1])], names=["key", "n"])

        for batch in batches:
            held.append(pc.list_flatten(batch.column(0)).to_numpy())
            size += len(held[-1])
            if size > _SEEN:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return lines.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c")).where(F.col("c") > most)


def packed(rows: DataFrame, total: int, without: np.ndarray | None = None) -> DataFrame:
    """(bucket, rows) of (keys, id, n): a row per key, those of a bucket of keys packed together; ``without`` has keys to leave out.

    ``total`` is about the number of rows, by which buckets get their size.
    """
    buckets = np.uint64(total // _BUCKET + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt():
            x = np.concatenate(held)
            if without is not None:
                x = x[~np.isin(x["key"], without)]
            bucket = (_mix(x["key"].view(np.uint64)) % buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = groups.runs(bucket[order])
            data = [None, pa.py_buffer((at * _ROW.itemsize).astype(np.int32)), pa.py_buffer(x[order].tobytes())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][at[:-1]]), pa.Array.from_buffers(pa.binary(), len(at) - 1, data)], names=["bucket", "rows"])

        for batch in batches:
            key = pc.list_flatten(batch.column(0)).to_numpy()
            many = pc.list_value_length(batch.column(0)).to_numpy()
            x = np.empty(len(key), _ROW)
            x["key"], x["id"], x["n"] = key, np.repeat(batch.column(1).to_numpy(), many), np.repeat(batch.column(2).to_numpy(), many)
            held.append(x)
            size += len(x)
            if size > _PACKED:
                yield dealt()
                held, size = [], 0
        if size:
            yield dealt()

    return rows.select("keys", "id", "n").mapInArrow(run, "bucket long, rows binary")


def band_groups(rows: DataFrame) -> DataFrame:
    """Distinct (gid, id) of the lines that share a band and may be alike by their sizes; rows are those of ``packed``."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        data = np.empty(batch.num_rows, object)
        data[:] = batch.column(1).to_pylist()
        return [batch.column(0).to_numpy(), data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in groups.whole_keys(batches, columns):
            rows = np.frombuffer(b"".join(data), _ROW)
            order = np.argsort(rows["key"])
            same = np.diff(rows["key"][order]) == 0
            rows = rows[order[np.append(same, False) | np.append(False, same)]]
            # Sorted by key, size and id: a run ends where the size grows by more than the threshold allows.
            rows = rows[np.lexsort((rows["id"], rows["n"], rows["key"]))]
            rows = rows[np.append(True, rows[1:] != rows[:-1])] if len(rows) else rows
            key, n, ids = rows["key"], rows["n"].astype(np.int64), np.ascontiguousarray(rows["id"])
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (100 * n[:-1] < PERCENT * n[1:]), [True]])) if len(rows) else np.zeros(1, np.int64)
            found = []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if y - x > 1:
                    order = np.argsort(ids[x:y])
                    found += groups.chunks(ids[x:y][order], n[x:y][order])
            if found:
                gids = [groups.group_id(g) for g in found]
                yield pa.RecordBatch.from_pydict({"gid": pa.array(np.repeat(np.array(gids, np.int64), [len(g) for g in found])), "id": pa.array(np.concatenate(found))})

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "gid long, id long").distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, members) of the lines in ``ids``: their texts, an eighth of the size of their sets."""
    if ids.count() <= BROADCAST_LINES:
        ids = F.broadcast(ids)
    rows = lines_of(docs).select(F.col("h").alias("id"), "line").join(ids, "id", "left_semi")
    return rows.groupBy("id").agg(F.min("line").cast("binary").alias("members"))


def line_links(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the bands of ``rows`` (bucket, rows), confirmed on full sets."""
    found = keep(band_groups(rows), "line-groups")
    out = keep(groups.linked(found, texts_of(docs, found.select("id").distinct()), percent, line_set, line_sets), "line-links")
    drop(found)
    return out


def line_components(docs: DataFrame, lines: DataFrame, percent: int = PERCENT, most: int = groups.MOST_ROWS) -> DataFrame:
    """(node, root) of the line hashes that are alike to another; ``lines`` are the signed lines of ``docs``."""
    lines = lines.where("keys IS NOT NULL").select("keys", F.col("h").alias("id"), "n")
    total = lines.count() * BANDS
    large = keep(crowded(lines, most), "large-bands")
    few = large.limit(BROADCAST_LINES + 1).count()
    if not few:
        drop(large)
        return components(line_links(packed(lines, total), docs, percent))
    each = lines.select(F.explode("keys").alias("key"), "id", "n")
    single = lambda df: df.select(F.array("key").alias("keys"), "id", "n")
    if few <= BROADCAST_LINES:
        rest = packed(lines, total, large.select("key").toArrow().column(0).to_numpy())
    else:
        rest = packed(single(each.join(large, "key", "left_anti")), total)
    held = each.join(large, "key").distinct()
    crowd = packed(single(groups.hub_blocks(held, most)), large.agg(F.sum("c")).first()[0])
    # Buckets of the two do not meet: keys of blocks are hashes of their own, and a key that is in both loses nothing.
    found = line_links(rest.union(crowd), docs, percent)
    comp = components(found)
    named = held.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp"), "n")
    out = groups.outsider_blocks(named, most)
    rest = line_links(packed(single(out), out.count()), docs, percent)
    comp = comp if rest.isEmpty() else components(found.union(rest))
    drop(large)
    return comp


def removals(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc, version, gone) of the documents that lose lines: the numbers of those, in order."""
    lines = keep(signed(lines_of(docs)), "line-bands")
    comp = line_components(docs, lines, percent)
    seen = lines.select("doc", "version", "line_no", "h")
    place = F.struct(F.col("doc").isNull().alias("late"), "doc", "version", "line_no")
    # First by hash, where partial sums take the copies of a line together, then by component; single lines go no further.
    first = seen.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
    rooted = keep(first.join(comp.withColumnRenamed("node", "h"), "h", "left").select("h", "first", "c", "root").where("c > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "h")), "line-roots")
    keeper = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    known = keep(rooted.join(keeper, "root").select("h", "keeper"), "line-keepers")
    gone = seen.join(known, "h").where(F.col("keeper") != place).groupBy("doc", "version").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    out = keep(gone, "gone-lines")
    drop(lines, rooted, known, comp)
    return out


def marked(docs: DataFrame, what: list[Column], percent: int) -> DataFrame:
    """``what`` of every row of ``docs``, and ``_gone``, the numbers of its removed lines (null if it keeps all)."""
    gone = removals(docs, percent).select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("gone").alias("_gone"))
    named = [c.alias(f"_own_{n}") for c, n in zip(document(), ("doc", "version"), strict=True)]
    rows = docs.select(*named, *what)
    return rows.join(gone, (F.col("_own_version") == F.col("_version")) & F.col("_own_doc").eqNullSafe(F.col("_doc")), "left").drop("_own_doc", "_own_version", "_doc", "_version")


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the text of each document reduced to its remaining lines; n_chars, where present, follows the text."""
    # The row is carried whole, so that its columns cannot clash with those of the join.
    rows = marked(docs, [F.struct(*docs.columns).alias("_row"), "text"], percent)
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(lines), lambda v: F.array_join(F.transform(left, lambda i: F.get(v, i)), "\n")), F.lit(0)))
    out = rows.withColumn("_text", text).where(F.col("_gone").isNull() | (F.trim("_text", F.lit(SEPARATORS)) != ""))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_lines (with a word), n_kept, and the numbers of the remaining lines."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("no"), line_hash(x).alias("h"), (F.trim(x, F.lit(SEPARATORS.replace("\n", ""))) != "").alias("word")))
    rows = marked(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.filter(lines, lambda x: x["word"]).alias("all")], percent)
    numbers = F.transform("all", lambda x: x["no"])
    kept = F.when(F.col("_gone").isNull(), numbers).otherwise(F.array_except(numbers, F.col("_gone")))
    rows = rows.withColumn("kept_lines", kept)
    return rows.select("doc_id", F.size("all").cast("long").alias("n_lines"), F.size("kept_lines").cast("long").alias("n_kept"), "kept_lines")
