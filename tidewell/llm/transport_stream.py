"""MPEG transport streams as a media column.

``mux`` stores bytes losslessly as a transport stream of one program: a program association table, a program map table, and one
elementary stream of PES packets with presentation timestamps. Every ``RANDOM_EVERY``-th PES packet is a random-access point: the
tables are repeated before it, its first packet sets the random-access indicator and carries a clock reference.

``parse`` reads any such stream: it follows the tables (checking their CRCs) to the elementary stream, checks continuity counters
packet by packet (one repeat of a packet is allowed, a gap is counted and ends the unit it cuts), reassembles PES packets, and
lists an access point per unit: timestamp, offset of its first packet, offset in the payload, random access or not. ``read_from``
starts at the last random-access point at or before a timestamp, without reading what precedes it.

Null bytes count as empty; an empty table gives an empty result; payloads of any length are taken whole, unit by unit. Added
columns replace ones of the same name and others pass through. Equal payloads give equal streams, so repeated rows stay equal.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET, BODY = 188, 184
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD
#: Payload bytes of a PES packet; its ticks of the 90 kHz clock; PES packets between random-access points.
UNIT, TICKS, RANDOM_EVERY = 8192, 3003, 4
_PTS_MASK = (1 << 33) - 1


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@lru_cache(1024)
def _crc_ok(section: bytes) -> bool:
    return crc32_mpeg(section) == 0


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _pid(flags: int, pid: int) -> bytes:
    return (flags << 13 | pid).to_bytes(2, "big")


_PAT = (b"\x00" + _section(0, 1, PROGRAM.to_bytes(2, "big") + _pid(7, PMT_PID))).ljust(BODY, b"\xff")
_PMT = (b"\x00" + _section(2, PROGRAM, _pid(7, DATA_PID) + b"\xf0\x00" + bytes([STREAM_TYPE]) + _pid(7, DATA_PID) + b"\xf0\x00")).ljust(BODY, b"\xff")
#: Heads of packets by continuity counter: whole packets of payload, and those with an adaptation field.
_PAT_HEAD, _PMT_HEAD = ([b"\x47" + _pid(2, pid) + bytes([0x10 | c]) for c in range(16)] for pid in (PAT_PID, PMT_PID))
_PLAIN, _ADAPTED = ([b"\x47" + _pid(0, DATA_PID) + bytes([kind << 4 | c]) for c in range(16)] for kind in (1, 3))
_START = [b"\x47" + _pid(2, DATA_PID) + bytes([0x30 | c]) for c in range(16)]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def build(payload: bytes) -> bytes:
    """The stream of a payload."""
    out, cc, tables = [], 0, 0
    for k in range(max(1, -(-len(payload) // UNIT))):
        unit, pts = payload[k * UNIT : (k + 1) * UNIT], k * TICKS & _PTS_MASK
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + unit
        if k % RANDOM_EVERY == 0:
            out += [_PAT_HEAD[tables & 15], _PAT, _PMT_HEAD[tables & 15], _PMT]
            tables += 1
            field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        else:
            field_ = b"\x00"
        room = BODY - 1 - len(field_)
        field_ += b"\xff" * (room - len(pes))
        out += [_START[cc], bytes([len(field_)]), field_, pes[:room]]
        cc = cc + 1 & 15
        for i in range(room, len(pes), BODY):
            part = pes[i : i + BODY]
            if len(part) == BODY:
                out += [_PLAIN[cc], part]
            else:
                pad = BODY - 1 - len(part)
                out += [_ADAPTED[cc], bytes([pad]), b"\x00" * min(pad, 1), b"\xff" * (pad - 1), part]
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    payload: bytes = b""
    points: list[tuple[int, int, int, bool]] = field(default_factory=list)
    packets: int = 0
    gaps: int = 0
    repeats: int = 0
    broken: int = 0


def parse(data: bytes, start: int = 0) -> Stream:
    """Demultiplex the first elementary stream of each program, from packet offset ``start`` on."""
    s, maps, wanted, last, parts = Stream(), {}, set(), {}, []
    unit: list[bytes] = []
    opened: tuple[int, bool] | None = None
    done = 0

    def close():
        nonlocal unit, opened, done
        if opened is None:
            return
        pes = b"".join(unit)
        at, random = opened
        unit, opened = [], None
        length = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or (length and len(pes) < length + 6):
            s.broken += 1
            return
        body = pes[9 + pes[8] : length + 6 if length else None]
        pts = -1
        if pes[7] & 0x80:
            a, b, c, d, e = pes[9:14]
            pts = (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1
        s.points.append((pts, at, done, random))
        parts.append(body)
        done += len(body)

    if len(data) % PACKET:
        raise ValueError("not a whole number of packets")
    for at in range(start, len(data), PACKET):
        if data[at] != 0x47:
            raise ValueError(f"no sync byte at {at}")
        pid, control, begins = (data[at + 1] & 0x1F) << 8 | data[at + 2], data[at + 3], data[at + 1] & 0x40
        s.packets += 1
        body, random = at + 4, False
        if control & 0x20:
            size = data[at + 4]
            random = bool(size and data[at + 5] & 0x40)
            body += 1 + size
        if not control & 0x10:
            continue
        before = last.get(pid)
        if before is not None:
            if control & 15 == before[0] and data[at + 4 : at + PACKET] == before[1]:
                s.repeats += 1
                continue
            if control & 15 != before[0] + 1 & 15:
                s.gaps += 1
                if pid in wanted and opened is not None:
                    unit, opened = [], None
                    s.broken += 1
        last[pid] = control & 15, data[at + 4 : at + PACKET]
        if pid in wanted:
            if begins:
                close()
                opened = at, random
            if opened is not None:
                unit.append(data[body : at + PACKET])
        elif (pid == PAT_PID or pid in maps) and begins:
            body += 1 + data[body]
            section = data[body : body + 3 + (int.from_bytes(data[body + 1 : body + 3], "big") & 0xFFF)]
            if not _crc_ok(section):
                raise ValueError(f"table checksum at {at}")
            if pid == PAT_PID:
                for i in range(8, len(section) - 4, 4):
                    maps[int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF] = int.from_bytes(section[i : i + 2], "big")
            else:
                i, streams = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF), {}
                while i < len(section) - 4:
                    streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                    i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)
                s.programs[maps[pid]] = streams
                wanted.update([*streams][:1])
    close()
    s.payload = b"".join(parts)
    return s


def read_from(data: bytes, points: list[tuple[int, int, int, bool]], pts: int) -> bytes:
    """The payload from the last random-access point at or before ``pts`` on; tables stand right before such a point."""
    at = max((p[1] for p in points if p[3] and p[0] <= pts), default=2 * PACKET)
    return parse(data, at - 2 * PACKET).payload


def feature(s: Stream) -> str:
    """What a stream holds, as text."""
    programs = ",".join(f"{n}:" + "+".join(f"{pid:#x}/{kind:#x}" for pid, kind in sorted(x.items())) for n, x in sorted(s.programs.items()))
    random = [p for p in s.points if p[3]]
    return f"programs={programs};packets={s.packets};units={len(s.points)};random={len(random)};pts={s.points[0][0]}-{s.points[-1][0]};gaps={s.gaps};repeats={s.repeats};broken={s.broken}"


def mux(df: DataFrame, payload: str = "payload", per_batch: int = 512) -> DataFrame:
    """``df`` with ``media``, the stream of column ``payload``, in the place of that column."""
    df = df.drop("media")
    c = df.columns.index(payload)
    fields = [T.StructField("media", T.BinaryType()) if f.name == payload else f for f in df.schema.fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, per_batch):
                batch = whole.slice(i, per_batch)
                columns = list(batch.columns)
                columns[c] = pa.array([build(x or b"") for x in batch.column(c).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, T.StructType(fields))


def demux(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``payload`` and ``points`` (the access points) read from column ``media``."""
    df = df.drop("payload", "points")
    c = df.columns.index(media)
    point = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("pts", "packet", "at")] + [T.StructField("random", T.BooleanType())]))
    schema = T.StructType([*df.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("points", point)])
    kind = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("at", pa.int64()), ("random", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else parse(x) for x in batch.column(c).to_pylist()]
            points = [None if s is None else [dict(zip(("pts", "packet", "at", "random"), p, strict=True)) for p in s.points] for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s and s.payload for s in found], pa.binary()), pa.array(points, kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def padded(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: texts padded, muxed into a media column, and everything else computed from that column."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.length(text)
    short = F.when(n == 0, F.lit(64)).otherwise(F.pmod(-n, F.lit(64)))
    zeros = F.substring(F.lit(bytes(64)), F.lit(1), short)
    rows = mux(docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(text, zeros).alias("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media in batch.column(2).to_pylist():
                s = parse(media)
                p = s.payload
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), sum(x[3] for x in s.points)))
            a, b, c, d, e, f, g = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": batch.column(1), "payload_bytes": pa.array(a, pa.int64()), "payload_sha256": pa.array(b, pa.string()), "tail_crc32": pa.array(c, pa.int64()),
                "media_bytes": pa.array(d, pa.int64()), "media_sha256": pa.array(e, pa.string()), "feature": pa.array(f, pa.string()), "random_points": pa.array(g, pa.int64()),
            })

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, random_points long")
