"""Token ids in directly addressable codes.

``write`` encodes every text with a public tokenizer, appends an end id, and writes ids in ascending doc_id order. Texts are
dealt by doc_id ranges and sorted within them; a task streams its range and starts a new file whenever the current one is
full, so memory is bounded by one file whatever the size of the range.

A file holds the ids of its documents as a DAC: level 0 has the low ``8`` bits of every id, level 1 the next 8 bits of the ids
that need them, and so on. Level k has a bitmap telling which entries continue on level k + 1, and a rank directory with the
number of ones before each 512-bit block. The place of an id on the next level is its rank, so any id is read with a few
byte reads and no decoding of a block. A document directory (doc_id, first id, number of ids) follows.

Layout, little-endian: ``TWDAC1\\0\\0``, u64 documents, u64 ids, u32 levels, u32 vocabulary; then per level u64 entries, chunk bytes,
bitmap (8-byte words), rank directory (u32 per block); then doc_ids (i64), a null mask (u8), starts (u64), counts (u64).

Null text counts as empty (its end id alone), null doc_id sorts first, rows with equal doc_id follow each other in the order of
their texts' hashes, over as many ranges as they need; an empty table writes no files and reads as no rows. A special token
that a text spells out gets its own id, as the tokenizers library does by default.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.files import put, resolve
from tidewell.llm.scratch import keep, new_dir

MAGIC = b"TWDAC1\0\0"
BLOCK = 512
FILE_IDS = 4_000_000
#: Pieces that an encoder remembers in each of two generations, about 100 MB together with their ids.
CACHE_ENTRIES = 500_000
VOCABULARY = "byte_bpe_50k.json"


def new_folder(spark: SparkSession) -> str:
    return new_dir(spark, "dac")


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(more) // BLOCK) * BLOCK // 8, np.uint8)
        words[: len(bits)] = bits
        ones = np.bitwise_count(words.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        levels.append(((rest & np.uint64(0xFF)).astype(np.uint8), words, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)))
        rest = rest[more] >> np.uint64(8)
        if not len(rest):
            return levels


def unpack(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids, from the last level up."""
    above = np.zeros(0, np.uint32)
    for chunks, words, _ in reversed(levels):
        ids = chunks.astype(np.uint32)
        if len(above):
            ids[np.unpackbits(words, count=len(chunks), bitorder="little").astype(bool)] |= above << np.uint32(8)
        above = ids
    return above


def access(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], i: int) -> int:
    """The id at place ``i``: on each level a chunk, a bit, and a rank from the directory and at most one block."""
    value = 0
    for k, (chunks, words, ranks) in enumerate(levels):
        value |= int(chunks[i]) << (8 * k)
        byte, bit = divmod(i, 8)
        if not words[byte] >> bit & 1:
            return value
        block = i // BLOCK
        before = int(np.bitwise_count(words[block * BLOCK // 8 : byte]).sum()) + int(words[byte] & ((1 << bit) - 1)).bit_count()
        i = int(ranks[block]) + before
    return value


def dump(out, doc_ids: list, counts: list[int], ids: np.ndarray) -> None:
    levels = pack(ids)
    out.write(MAGIC + struct.pack("<QQII", len(doc_ids), len(ids), len(levels), 0))
    for chunks, words, ranks in levels:
        out.write(struct.pack("<Q", len(chunks)) + chunks.tobytes() + words.tobytes() + ranks.tobytes())
    n = np.array(counts, np.uint64)
    out.write(np.array([d or 0 for d in doc_ids], np.int64).tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write((np.cumsum(n) - n).astype(np.uint64).tobytes() + n.tobytes())


def load(data: bytes):
    """(levels, doc_ids with None for null, starts, counts)"""
    if data[:8] != MAGIC:
        raise ValueError("not a DAC file")
    docs, _, n_levels, _ = struct.unpack_from("<QQII", data, 8)
    at, levels = 32, []

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    for _ in range(n_levels):
        n = int(take("<u8", 1)[0])
        blocks = -(-n // BLOCK)
        levels.append((take(np.uint8, n), take(np.uint8, blocks * BLOCK // 8), take("<u4", blocks)))
    doc_ids, null = take("<i8", docs), take(np.uint8, docs)
    return levels, [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], take("<u8", docs), take("<u8", docs)


class Encoder:
    """Ids of texts as little-endian unsigned integers, exactly as the tokenizers library gives them for the whole text.

    A byte-level tokenizer cuts a text before each space that stands alone, so the pieces between such cuts are encoded once
    and remembered, letters and what follows them apart. Texts where white space surrounds white space, or with a special token,
    are encoded whole.
    """

    def __init__(self, path: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.model.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: A word and what follows it; the tokenizer always cuts between letters and other characters.
        self.core = re.compile(r" [A-Za-zÀ-ÖØ-öø-ſ]+(?=[\x00-@\[-`{-~]|$)").match
        self.space = self.model.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        #: A space with white space on both sides; it begins with a literal, for which the search is quick.
        self.spaced = re.compile(r" (?=\s)(?<=\s )").search
        #: Tokens that the library finds before it cuts a text.
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]

    def learn(self, pieces: list[str]) -> None:
        """Words of plain letters go straight to the model's merges; the rest through the whole tokenizer."""
        tokenize, rest = self.model.model.tokenize, []
        for x in pieces:
            if x[0] == " " and len(x) > 1 and x.isascii() and x[1:].isalpha():
                self.known[x] = np.array([t.id for t in tokenize(self.space + x[1:])], self.kind).tobytes()
            else:
                rest.append(x)
        for i in range(0, len(rest), 50_000):
            part = rest[i : i + 50_000]
            self.known.update(zip(part, self.whole(part), strict=True))

    def unsafe(self, text: str) -> bool:
        return bool(self.spaced(text)) or any(x in text for x in self.added)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.unsafe(t) else t.split(" ") for t in texts]
        for c in cut:
            if c:
                c[1:] = [" " + x for x in c[1:]]
        if len(self.known) > CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        known, recall, split, missing = self.known, self.older.get, [], set()
        for x in [x for x in set().union(*[c for c in cut if c]) if x not in known]:
            if ids := recall(x):
                known[x] = ids
            elif (m := self.core(x)) and m.end() < len(x):
                split.append((x, m[0], x[m.end() :]))
            else:
                missing.add(x)
        for _, core, tail in split:
            for x in (core, tail):
                if x not in known:
                    if ids := recall(x):
                        known[x] = ids
                    else:
                        missing.add(x)
        missing.discard("")
        known[""] = b""
        self.learn(list(missing))
        for x, core, tail in split:
            known[x] = known[core] + known[tail]
        return [self.whole([t])[0] if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS, per_batch: int = 256) -> DataFrame:
    """Write ``docs`` (doc_id, text) under ``folder``; returns (file, first_doc, nulls_first, part, seq, n_docs, n_ids), a row per file."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.kind).tobytes()
        doc_ids, counts, chunks, total = [], [], [], 0

        def flush():
            nonlocal doc_ids, counts, chunks, total, seq
            name = f"{folder}/part-{part:06d}-{seq:06d}.dac"
            ids = np.frombuffer(b"".join(chunks), encode.kind)
            put(name, lambda out: dump(out, doc_ids, counts, ids))
            row = pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(doc_ids)], "n_ids": [total]})
            doc_ids, counts, chunks, total, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(keys), per_batch):
                some = [t or "" for t in texts.slice(i, per_batch).to_pylist()]
                for key, ids in zip(keys[i : i + per_batch], encode(some), strict=True):
                    chunks.append(ids + end)
                    doc_ids.append(key)
                    counts.append(len(chunks[-1]) // encode.kind.itemsize)
                    total += counts[-1]
                    if total >= file_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return keep(ordered.mapInArrow(run, "file string, part int, seq int, n_docs long, n_ids long"), "dac-files")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files that ``write`` listed, a task per file.

    Starts are sums over the files of a part, and over the parts before it: a row per task of ``write``.
    """
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(F.col("part"), before(Window.orderBy("part")).alias("parts_before"))
    listed = files.withColumn("own_before", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part")
    listed = listed.select("file", (F.col("own_before") + F.col("parts_before")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = resolve(name)
                with store.open_input_stream(path) as src:
                    levels, doc_ids, starts, counts = load(src.read())
                raw, crc = memoryview(unpack(levels).astype("<u4")).cast("B"), []
                for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts.astype(np.int64) + before), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())
                })

    return listed.repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


digest = read


def token(name: str, i: int) -> int:
    """Id ``i`` of a file by random access: per level its size, a chunk, a bitmap block and a rank are read."""
    store, path = resolve(name)
    with store.open_input_file(path) as src:
        if src.read_at(8, 0) != MAGIC:
            raise ValueError("not a DAC file")
        total, n_levels, _ = struct.unpack("<QII", src.read_at(16, 16))
        if not 0 <= i < total:
            raise IndexError(i)
        value, at = 0, 32
        for k in range(n_levels):
            n = struct.unpack("<Q", src.read_at(8, at))[0]
            words, blocks = at + 8 + n, -(-n // BLOCK)
            value |= src.read_at(1, at + 8 + i)[0] << (8 * k)
            block, bit = divmod(i, BLOCK)
            bits = int.from_bytes(src.read_at(BLOCK // 8, words + block * BLOCK // 8), "little")
            if not bits >> bit & 1:
                break
            ranks = words + blocks * BLOCK // 8
            i = struct.unpack("<I", src.read_at(4, ranks + 4 * block))[0] + (bits & ((1 << bit) - 1)).bit_count()
            at = ranks + 4 * blocks
        return value


__all__ = ["Encoder", "access", "digest", "dump", "encoder", "load", "new_folder", "pack", "read", "token", "unpack", "write"]
