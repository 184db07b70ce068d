"""SentencePiece BPE with seeded merge-dropout, and its lossless inverse.

Encoding runs the merge agenda of a public SentencePiece BPE model: of all adjacent pairs whose join is a piece, the best-scored
and leftmost merges first. A candidate merge is skipped when the keyed hash of (seed, doc_id, the word's place in the text, place
and sizes in the word) falls below ``dropout``; being a function of the candidate alone, a skip does not depend on the order of
work, on retries or on partitions. Every occurrence of a word draws for itself, and ``dropout=0`` gives exactly the model's own
encoding. Rows with the same doc_id draw alike, those without one too.

An encoder remembers a word's agenda without dropout: its ids and the candidates that came up on the way. An occurrence that
skips none of them has the same agenda; every other one runs its own. What is remembered saves work and limits nothing.
With ``variants`` given, a word has that many segmentations at most: one per variant, which its place in the text selects.

Characters without a piece become byte pieces; U+2581, which the model uses for a space, does too when it stands in a text.
So decoding joins the bytes of the pieces and drops the leading space mark, whatever was merged.

Null text encodes as the empty text (no ids); an empty table gives an empty result. Texts are cut at single spaces and line
feeds, never shortened; words of any length are handled, long ones by a heap in n log n steps. Extra columns pass through;
the added column replaces one of the same name. Repeated rows and null doc_ids encode like any other row.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
DROPOUT, SEED = 0.1, 20
#: Words that an encoder with variants remembers in each of two generations.
CACHE_ENTRIES = 250_000
#: Agendas that an encoder remembers before it starts anew, and words that go through them at a time.
AGENDAS, WORDS_AT_ONCE = 250_000, 50_000
LONG_WORD = 100
NEVER = np.int64(2**31 - 1)
_PLACES = 1 << 12
_START, _LEFT, _RIGHT, _GOLD = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


class Pieces:
    """A model's pieces: merge table, bytes of each piece, ids of single characters and of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {text[i]: i for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = text[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        # Words keep their spaces; a space is looked up as the mark that pieces use for it.
        self.char_id[ord(" ")] = self.char_id[ord(SPACE)]
        rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        found = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    found[a * n + b] = (rank[i], i)
        self.n = n
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.rank, self.to = (np.array([found[k][j] for k in self.keys.tolist()], np.int64) for j in (0, 1))
        self.kind = np.dtype("<u2") if n <= 65536 else np.dtype("<u4")


class Agendas:
    """Words by number, with the agenda that they have without dropout: its ids and its candidates' places."""

    def __init__(self, line: bytes, mark: bytes):
        self.number: dict[str, int] = {}
        #: None for words that are too long to run in step; every occurrence runs its own agenda.
        self.ids: list[bytes | None] = []
        self.counts = self.firsts = self.places = np.zeros(0, np.int64)
        self.add(["\n", SPACE], [line, mark], np.zeros(2, np.int64), np.zeros(0, np.int64))

    def add(self, words: list[str], ids: list[bytes | None], counts: np.ndarray, places: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.ids), len(self.ids) + len(words)), strict=True))
        self.ids += ids
        self.firsts = np.concatenate([self.firsts, np.cumsum(counts) - counts + len(self.places)])
        self.counts = np.concatenate([self.counts, counts])
        self.places = np.concatenate([self.places, places])


class Encoder:
    def __init__(self, path: str, dropout: float = DROPOUT, variants: int | None = None, seed: int = SEED):
        self.p, self.dropout, self.variants, self.seed = Pieces(path), dropout, variants, seed
        self.below = np.uint64(math.ceil(dropout * 2**53))
        self.line = np.array([self.p.byte_ids[10]], self.p.kind).tobytes()
        self.mark = np.array([self.p.byte_ids[b] for b in SPACE.encode()], self.p.kind).tobytes()
        self.agendas = Agendas(self.line, self.mark)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        drawn = _mix(np.arange(_PLACES, dtype=np.uint64) * _GOLD + np.uint64(seed)) % np.uint64(variants or 1)
        self.places = "".join(chr(48 + int(v)) for v in drawn) * 2

    # Skips -----------------------------------------------------------------------------------------------------------
    def _skipped(self, key, start, left, right):
        with np.errstate(over="ignore"):
            x = key + start.astype(np.uint64) * _START + left.astype(np.uint64) * _LEFT + right.astype(np.uint64) * _RIGHT
        return (_mix(x) >> np.uint64(11)) < self.below

    def word_key(self, keyed: str) -> int:
        return xxhash.xxh3_64_intdigest(keyed.encode(), seed=self.seed)

    # One word, by an agenda ------------------------------------------------------------------------------------------
    def agenda(self, word: str, key: int) -> list[int]:
        """Ids of a word; -1 - code point for characters without a piece."""
        p, n = self.p, len(word)
        ids = [int(p.char_id[ord(c)]) for c in word]
        size, after, before, heap = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1)), []
        one = np.uint64(key)

        def offer(i):
            j = after[i] if i >= 0 else n
            if j < n and ids[i] >= 0 and ids[j] >= 0 and (hit := p.pairs.get(ids[i] * p.n + ids[j])):
                at = np.array([i]), np.array([size[i]]), np.array([size[j]])
                if not self._skipped(np.array([one]), *at)[0]:
                    heapq.heappush(heap, (hit[0], i, size[i], size[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, to = heapq.heappop(heap)
            j = after[i]
            if size[i] != left or j >= n or size[j] != right:
                continue
            ids[i], size[i], size[j], after[i] = to, left + right, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [ids[i] if ids[i] >= 0 else -1 - ord(word[i]) for i in range(n) if size[i]]

    # Many words at once ----------------------------------------------------------------------------------------------
    def segment(self, words: list[str], keys: np.ndarray | None, seen: list[np.ndarray] | None = None) -> list[bytes]:
        """The agenda of every word in step: a round merges the best candidate of each word that has one.

        Skips are drawn by ``keys``. Without keys nothing is skipped and words are short; ``seen`` takes the candidates, each as its
        word's number, its place and its two sizes in one integer.
        """
        p, out = self.p, [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._bytes(self.agenda(w, int(keys[i])))
        if not short:
            return out
        text = "".join([words[i] for i in short])
        lens = np.array([len(words[i]) for i in short])
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        own = np.repeat(np.arange(len(short)), lens)
        first = np.cumsum(lens) - lens
        start = np.arange(len(points)) - first[own]
        size = np.ones(len(points), np.int64)
        sym = p.char_id[points].astype(np.int64)
        sym = np.where(sym < 0, -1 - points, sym)
        key = keys[short] if keys is not None else None

        def pairs(i):
            """Rank and product of the candidates (i, i + 1)."""
            j = np.minimum(i + 1, len(sym) - 1)
            a, b = sym[i], sym[j]
            code = np.where((i + 1 < len(sym)) & (own[i] == own[j]) & (a >= 0) & (b >= 0), a * p.n + b, -1)
            at = np.minimum(np.searchsorted(p.keys, code), len(p.keys) - 1)
            hit = np.flatnonzero(p.keys[at] == code)
            rank, to = np.full(len(i), NEVER), np.zeros(len(i), np.int64)
            if len(hit):
                ih = i[hit]
                if key is None:
                    seen.append(own[ih] << 21 | start[ih] << 14 | size[ih] << 7 | size[j[hit]])
                    ok = hit
                else:
                    ok = hit[~self._skipped(key[own[ih]], start[ih], size[ih], size[j[hit]])]
                rank[ok], to[ok] = p.rank[at[ok]], p.to[at[ok]]
            return rank, to

        rank, to = pairs(np.arange(len(sym)))
        done_own, done_sym = [], []
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), heads)
            live = (best >> 32) < NEVER
            n_dead = len(live) - int(live.sum())
            if n_dead * 4 >= len(live):
                stays = np.repeat(live, np.diff(np.append(heads, len(sym))))
                done_own.append(own[~stays])
                done_sym.append(sym[~stays])
                sym, own, start, size, rank, to = (x[stays] for x in (sym, own, start, size, rank, to))
                continue
            at = best[live] & 0xFFFFFFFF
            sym[at] = to[at]
            size[at] += size[at + 1]
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            sym, own, start, size, rank, to = (x[stays] for x in (sym, own, start, size, rank, to))
            at = at - np.arange(len(at))
            left = at[(at > 0)] - 1
            again = np.concatenate([at, left[own[left] == own[left + 1]]])
            rank[again], to[again] = pairs(again)
        own, sym = np.concatenate(done_own), np.concatenate(done_sym)
        order = np.argsort(own, kind="stable")
        own, sym = own[order], sym[order]
        ends = np.searchsorted(own, np.arange(len(short)), side="right")
        odd = np.zeros(len(short), bool)
        odd[own[sym < 0]] = True
        raw, width, a = np.maximum(sym, 0).astype(p.kind).tobytes(), p.kind.itemsize, 0
        for i, b, o in zip(short, ends.tolist(), odd.tolist(), strict=True):
            out[i] = self._bytes(sym[a:b].tolist()) if o else raw[a * width : b * width]
            a = b
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        flat = []
        for i in ids:
            flat += [i] if i >= 0 else [self.p.byte_ids[b] for b in chr(-1 - i).encode()]
        return np.array(flat, self.p.kind).tobytes()

    # Texts -----------------------------------------------------------------------------------------------------------
    @staticmethod
    def words(line: str) -> list[str]:
        if "  " in line:
            return re.findall(r" *[^ ]+| +", line)
        first, *rest = line.split(" ")
        return ([first] if first else []) + [" " + w for w in rest]

    def keyed(self, text: str, place: int) -> list[list[str] | bytes]:
        """Per line its words, each with its variant in front; breaks between them as bytes."""
        if not text:
            return []
        out: list[list[str] | bytes] = []
        parts = re.split(f"([\n{SPACE}])", " " + text) if SPACE in text else None
        at = place % _PLACES
        for i, line in enumerate(parts or (" " + text).split("\n")):
            if parts and i % 2:
                out.append(self.line if line == "\n" else self.mark)
                continue
            if not parts and i:
                out.append(self.line)
            w = self.words(line) if line else []
            if len(w) <= _PLACES:
                out.append([a + b for a, b in zip(self.places[at : at + len(w)], w, strict=True)])
            else:
                out.append([self.places[(at + j) % _PLACES] + b for j, b in enumerate(w)])
            at = (at + len(w)) % _PLACES
        return out

    def items(self, text: str) -> list[str]:
        """The words of a text, and its breaks as items of their own."""
        if not text:
            return []
        out = []
        parts = re.split(f"([\n{SPACE}])", " " + text) if SPACE in text else None
        for i, line in enumerate(parts or (" " + text).split("\n")):
            if parts and i % 2:
                out.append(line)
                continue
            if not parts and i:
                out.append("\n")
            if line:
                out += self.words(line)
        return out

    def _learn(self, words: list[str]) -> None:
        short, long = [w for w in words if len(w) <= LONG_WORD], [w for w in words if len(w) > LONG_WORD]
        for i in range(0, len(short), 20_000):
            part, seen = short[i : i + 20_000], [np.zeros(0, np.int64)]
            ids = self.segment(part, None, seen)
            found = np.sort(np.concatenate(seen))
            self.agendas.add(part, ids, np.bincount(found >> 21, minlength=len(part)), found & (1 << 21) - 1)
        self.agendas.add(long, [None] * len(long), np.zeros(len(long), np.int64), np.zeros(0, np.int64))

    def _occurrences(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """The ids of every word, whose candidates are drawn by its key."""
        if len(self.agendas.ids) > AGENDAS:
            self.agendas = Agendas(self.line, self.mark)
        known = self.agendas
        self._learn([w for w in set(words) if w not in known.number])
        at = np.fromiter(map(known.number.__getitem__, words), np.int64, len(words))
        out = list(map(known.ids.__getitem__, at.tolist()))
        own = [i for i, x in enumerate(out) if x is None]
        if self.dropout > 0:
            count = known.counts[at]
            starts = np.cumsum(count) - count
            places = known.places[np.arange(int(count.sum())) + np.repeat(known.firsts[at] - starts, count)]
            skipped = self._skipped(np.repeat(keys, count), places >> 14, places >> 7 & 127, places & 127)
            own += np.unique(np.repeat(np.arange(len(words)), count)[skipped]).tolist()
        for i in range(0, len(own), 20_000):
            part = own[i : i + 20_000]
            for j, x in zip(part, self.segment([words[j] for j in part], keys[part]), strict=True):
                out[j] = x
        return out

    def __call__(self, texts: list[str], places: list[int]) -> list[bytes]:
        if self.variants:
            return self.by_variant(texts, places)
        items = [self.items(t) for t in texts]
        words = [w for x in items for w in x]
        ends = np.cumsum([len(x) for x in items]) if items else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            of_text = _mix(np.array([x & (1 << 64) - 1 for x in places], np.uint64) + np.uint64(self.seed & (1 << 64) - 1) * _RIGHT)
            n = np.array([len(x) for x in items], np.int64)
            keys = _mix(np.repeat(of_text, n) + (np.arange(len(words)) - np.repeat(ends - n, n)).astype(np.uint64) * _GOLD)
        ids = []
        for i in range(0, len(words), WORDS_AT_ONCE):
            ids += self._occurrences(words[i : i + WORDS_AT_ONCE], keys[i : i + WORDS_AT_ONCE])
        return [b"".join(ids[b - len(x) : b]) for x, b in zip(items, ends.tolist(), strict=True)]

    def by_variant(self, texts: list[str], places: list[int]) -> list[bytes]:
        cut = [self.keyed(t, x) for t, x in zip(texts, places, strict=True)]
        wanted = {w for c in cut for line in c if type(line) is list for w in line}
        if len(self.known) > CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        known, older, missing = self.known, self.older, []
        for w in [w for w in wanted if w not in known]:
            if w in older:
                known[w] = older[w]
            else:
                missing.append(w)
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            keys = np.fromiter(map(self.word_key, part), np.uint64, len(part))
            known.update(zip(part, self.segment([w[1:] for w in part], keys), strict=True))
        get = known.__getitem__
        return [b"".join([line if type(line) is bytes else b"".join(map(get, line)) for line in c]) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the text."""
        return b"".join(map(self.p.bytes.__getitem__, np.frombuffer(ids, self.p.kind).tolist()))[1:]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def place_of(doc_id, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(str(doc_id).encode(), seed=seed)


def encode(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, variants: int | None = None, seed: int = SEED, per_batch: int = 512) -> DataFrame:
    """``docs`` with ``piece_ids``: the ids as little-endian unsigned integers, 2 bytes each (4 for models over 65,536 pieces)."""
    key = (model or model_path(), dropout, variants, seed)
    docs = docs.drop("piece_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.BinaryType())])
    t, d = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*key)
        for whole in batches:
            for i in range(0, whole.num_rows, per_batch):
                batch = whole.slice(i, per_batch)
                ids = enc([x or "" for x in batch.column(t).to_pylist()], [place_of(x, seed) for x in batch.column(d).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "piece_ids"])

    return docs.mapInArrow(run, schema)


def decodes(enc: Encoder, texts: list[str], ids: list[bytes]) -> list[bool]:
    """Whether the ids of each text decode to it."""
    return [enc.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]


def encode_checked(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, per_batch: int = 512) -> DataFrame:
    """``docs`` with ``piece_ids`` and ``lossless``: encoded and decoded again by one worker, which holds the model once."""
    key = (model or model_path(), dropout, None, seed)
    docs = docs.drop("piece_ids", "lossless")
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.BinaryType()), T.StructField("lossless", T.BooleanType())])
    t, d = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*key)
        for whole in batches:
            for i in range(0, whole.num_rows, per_batch):
                batch = whole.slice(i, per_batch)
                texts = [x or "" for x in batch.column(t).to_pylist()]
                ids = enc(texts, [place_of(x, seed) for x in batch.column(d).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(decodes(enc, texts, ids))], names=[*batch.schema.names, "piece_ids", "lossless"])

    return docs.mapInArrow(run, schema)


def decode(pieces: DataFrame, model: str | None = None) -> DataFrame:
    """``pieces`` with ``decoded``, the text of ``piece_ids``."""
    key = (model or model_path(), 0.0)
    pieces = pieces.drop("decoded")
    schema = T.StructType([*pieces.schema.fields, T.StructField("decoded", T.StringType())])
    c = pieces.columns.index("piece_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*key)
        for batch in batches:
            texts = [None if x is None else enc.decode(x).decode() for x in batch.column(c).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return pieces.mapInArrow(run, schema)


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32, decoded_bytes and lossless per document, encoded and decoded again in one pass."""
    key = (model or model_path(),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*key)
        width = enc.p.kind.itemsize
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                ids = enc(texts, [place_of(x, SEED) for x in batch.column(0).to_pylist()])
                back = [enc.decode(x) for x in ids]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0), "n_pieces": pa.array([len(x) // width for x in ids], pa.int64()), "pieces_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    "decoded_bytes": pa.array([len(x) for x in back], pa.int64()), "lossless": pa.array([b == t.encode() for b, t in zip(back, texts, strict=True)]),
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, pieces_crc32 long, decoded_bytes long, lossless boolean")
