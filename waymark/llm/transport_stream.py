"""Media columns: payloads stored as MPEG transport streams.

``stored_streams`` writes a payload as 188-byte packets: a program association
table, a program map table and one elementary stream of packets with
presentation times; every elementary packet starts at a random-access point.
``read_streams`` parses any transport stream, whoever wrote it. It assembles
table sections from as many packets as they take (and checks their CRC), finds
every elementary stream of every program, verifies continuity counters, joins
elementary packets of stated or open length, and lists presentation and decoding
times, program clocks and random-access points. The payload of a stream of
several is that of the first elementary stream of the first program.

Edge cases: a null or empty text is one block of padding; texts of any length
are cut into elementary packets of bounded size; equal texts (ties, repeated
rows) give equal streams; an empty table gives an empty one; bytes that are no
stream, or a stream without tables, give an empty payload and a feature that
says so. Packets that are marked as damaged, or have no sync byte, count as
errors and are left out, as are elementary packets with a gap or of a wrong
size. Columns that bear the name of a result are replaced, all others pass.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import stored

PACKET, BLOCK = 188, 192
_PMT_PID, _ES_PID, _PROGRAM = 0x1000, 0x0100, 1
#: Payload bytes of an elementary packet, and its time step on the 90 kHz clock.
_UNIT, _STEP = 64 * BLOCK, 3600
_ROWS = 512


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables; 0 over a section that ends with its own."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, _PROGRAM.to_bytes(2, "big") + (0xE000 | _PMT_PID).to_bytes(2, "big"))) + _table_packet(
    _PMT_PID,
    _section(2, _PROGRAM, (0xE000 | _ES_PID).to_bytes(2, "big") + b"\xf0\0\x06" + (0xE000 | _ES_PID).to_bytes(2, "big") + b"\xf0\0"),
)


def _time(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``."""
    parts, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), _UNIT)):
        unit = payload[at : at + _UNIT]
        pts = k * _STEP & (1 << 33) - 1
        body = b"\0\0\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(pts) + unit
        # The first packet's adaptation field: random access and the program clock.
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        field_ = b"\x50" + clock
        first = min(len(body), PACKET - 5 - len(field_))
        rest = len(body) - first
        n = 1 + -(-rest // 184)
        packets = np.zeros((n, PACKET), np.uint8)
        packets[:, 0] = 0x47
        packets[:, 1] = _ES_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = _ES_PID & 0xFF
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        packets[0, 3] |= 0x20
        counter = counter + n & 15
        head = field_.ljust(PACKET - 5 - first, b"\xff")
        packets[0, 4] = len(head)
        packets[0, 5:] = np.frombuffer(head + body[:first], np.uint8)
        full = rest // 184
        if full:
            packets[1 : 1 + full, 4:] = np.frombuffer(body, np.uint8, full * 184, first).reshape(full, 184)
        if tail := rest - full * 184:
            packets[-1, 3] |= 0x20
            stuffing = 184 - tail - 1
            packets[-1, 4] = stuffing
            if stuffing:
                packets[-1, 5] = 0
                packets[-1, 6 : 5 + stuffing] = 0xFF
            packets[-1, PACKET - tail :] = np.frombuffer(body, np.uint8, tail, len(body) - tail)
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Elementary:
    """An elementary stream: what its packets hold."""

    program: int
    kind: int
    pid: int
    payload: bytes = b""
    units: int = 0
    broken: int = 0
    counter_errors: int = 0
    times: list[int] = field(default_factory=list)
    decoding_times: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)


@dataclass
class Stream:
    """What a transport stream holds; times on the 90 kHz clock, program clocks on that of 27 MHz."""

    packets: int = 0
    sync_errors: int = 0
    table_errors: int = 0
    programs: list[int] = field(default_factory=list)
    streams: list[Elementary] = field(default_factory=list)
    clocks: dict[int, list[int]] = field(default_factory=dict)

    @property
    def first(self) -> Elementary:
        return self.streams[0] if self.streams else Elementary(0, 0, 0)

    @property
    def payload(self) -> bytes:
        return self.first.payload

    @property
    def units(self) -> int:
        return self.first.units

    @property
    def times(self) -> list[int]:
        return self.first.times

    @property
    def access_points(self) -> list[int]:
        return self.first.access_points

    @property
    def broken_units(self) -> int:
        return sum(s.broken for s in self.streams)

    @property
    def counter_errors(self) -> int:
        return self.sync_errors + sum(s.counter_errors for s in self.streams)

    def feature(self) -> str:
        one = self.first
        first, last = (one.times[0], one.times[-1]) if one.times else (-1, -1)
        return (
            f"packets={self.packets};streams={len(self.streams)};units={one.units};pts={first}-{last};access={len(one.access_points)};"
            f"clocks={sum(map(len, self.clocks.values()))};counter_errors={self.counter_errors};table_errors={self.table_errors};broken={one.broken}"
        )


_SECTIONS: dict[bytes, tuple[int, int, bytes] | None] = {}


def _read_section(section: bytes) -> tuple[int, int, bytes] | None:
    """(table id, number, body) of a whole section; None if it is damaged."""
    if section not in _SECTIONS:
        if len(_SECTIONS) > 1000:
            _SECTIONS.clear()
        whole = len(section) >= 12 and section_crc(section) == 0
        _SECTIONS[section] = (section[0], int.from_bytes(section[3:5], "big"), section[8:-4]) if whole else None
    return _SECTIONS[section]


class _Packets:
    """The packets of a transport stream as an array, with their headers."""

    def __init__(self, data: bytes) -> None:
        # Packets start where one sync byte follows another.
        starts = (i for i in range(min(PACKET, len(data))) if data[i] == 0x47 and (i + PACKET >= len(data) or data[i + PACKET] == 0x47))
        skip = next(starts, 0)
        n = (len(data) - skip) // PACKET
        grid = np.frombuffer(data, np.uint8, n * PACKET, skip).reshape(n, PACKET)
        adaptation = np.where(grid[:, 3] & 0x20, grid[:, 4].astype(np.int32) + 1, 0) if n else np.zeros(0, np.int32)
        sound = (grid[:, 0] == 0x47) & ((grid[:, 1] & 0x80) == 0) & (adaptation <= 184)
        self.errors = int(n - sound.sum()) + (skip > 0)
        self.grid = grid = grid[sound] if not sound.all() else grid
        self.begin = 4 + (adaptation[sound] if not sound.all() else adaptation)
        self.pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
        self.loaded = ((grid[:, 3] & 0x10) > 0) & (self.begin < PACKET)
        self.starts = (grid[:, 1] & 0x40) > 0
        self.flags = np.where(self.begin > 5, grid[:, 5], 0)

    def of(self, pid: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the packets with payload, whether one is lost before each); repeated packets are left out."""
        mine = np.flatnonzero((self.pid == pid) & self.loaded)
        if not len(mine):
            return mine, np.zeros(0, bool)
        count = self.grid[mine, 3] & 15
        again = np.r_[False, (count[1:] == count[:-1]) & (self.grid[mine[1:], 4:] == self.grid[mine[:-1], 4:]).all(axis=1)]
        mine, count = mine[~again], count[~again]
        # A packet that announces a discontinuity may have any number.
        told = (self.flags[mine] & 0x80) > 0
        return mine, np.r_[False, ((count[1:] - count[:-1]) & 15 != 1) & ~told[1:]]

    def body(self, places: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(payloads of the packets, one after the other; where each starts and the last ends)."""
        begin = self.begin[places]
        inside = np.arange(PACKET)[None, :] >= begin[:, None]
        return self.grid[places][inside].tobytes(), np.r_[0, np.cumsum(PACKET - begin)]

    def sections(self, pid: int) -> Iterator[bytes | None]:
        """Whole sections of a table's packets, from as many packets as each takes; None for one that is lost."""
        places, gap = self.of(pid)
        held = b""
        for i, lost in zip(places.tolist(), gap.tolist(), strict=True):
            body = self.grid[i, self.begin[i] :].tobytes()
            if lost and held:
                yield None
                held = b""
            if self.starts[i]:
                pointer = body[0]
                yield from self._cut(held + body[1 : 1 + pointer]) if held else ()
                held = body[1 + pointer :]
            elif held:
                held += body
            while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)):
                yield held[:size]
                held = held[size:]
            if held[:1] == b"\xff":
                held = b""
        if held:
            yield None

    @staticmethod
    def _cut(held: bytes) -> Iterator[bytes | None]:
        size = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)
        yield held[:size] if len(held) >= max(3, size) else None

    def clocks(self, pid: int) -> list[int]:
        """Program clock references of a packet identifier's adaptation fields, on the 27 MHz clock."""
        rows = self.grid[(self.pid == pid) & ((self.flags & 0x10) > 0) & (self.begin >= 12), 6:12]
        raw = [int.from_bytes(r.tobytes(), "big") for r in rows]
        return [(x >> 15) * 300 + (x & 0x1FF) for x in raw]


def _time_of(raw: bytes) -> int:
    a, b, c, d, e = raw
    return (a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1


#: Stream ids whose packets have no header of times, and the one of padding.
_BARE, _PADDING = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE


def _read_elementary(packets: _Packets, found: Elementary) -> Elementary:
    places, gap = packets.of(found.pid)
    found.counter_errors = int(gap.sum())
    found.access_points = np.flatnonzero((packets.flags[places] & 0x40) > 0).tolist()
    first = np.flatnonzero(packets.starts[places])
    if not len(first):
        return found
    body, edge = packets.body(places)
    damaged = np.add.reduceat(gap & ~packets.starts[places], first) > 0
    kept = []
    for k, i in enumerate(first.tolist()):
        end = first[k + 1] if k + 1 < len(first) else len(places)
        unit = body[edge[i] : edge[end]]
        found.units += 1
        stated = int.from_bytes(unit[4:6], "big")
        bare = unit[3:4] and unit[3] in _BARE
        head = 6 if bare else 9 + unit[8] if len(unit) >= 9 else 9
        # A length of 0 is open: the packet ends where the next one starts.
        last = 6 + stated if stated else len(unit)
        if unit[:3] != b"\0\0\x01" or last > len(unit) or head > last or damaged[k]:
            found.broken += 1
            continue
        if not bare and unit[7] & 0x80 and unit[8] >= 5:
            found.times.append(_time_of(unit[9:14]))
            if unit[7] & 0x40 and unit[8] >= 10:
                found.decoding_times.append(_time_of(unit[14:19]))
        if unit[3] != _PADDING:
            kept.append(unit[head:last])
    found.payload = b"".join(kept)
    return found


def read_stream(data: bytes) -> Stream:
    """Parse a transport stream; damage is counted."""
    packets = _Packets(data)
    found = Stream(len(packets.grid), packets.errors)

    def tables(pid: int, wanted: int) -> Iterator[tuple[int, bytes]]:
        for section in packets.sections(pid):
            got = _read_section(section) if section is not None else None
            if got is None:
                found.table_errors += 1
            elif got[0] == wanted:
                yield got[1:]

    maps: dict[int, int] = {}
    for _, body in tables(0, 0):
        for i in range(0, len(body) - 3, 4):
            # Program 0 names the network table.
            if number := int.from_bytes(body[i : i + 2], "big"):
                maps.setdefault(number, int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF)
    read: dict[int, list[tuple[int, bytes]]] = {}
    seen: set[int] = set()
    for program, pid in maps.items():
        if pid not in read:
            read[pid] = list(tables(pid, 2))
        body = next((b for number, b in read[pid] if number == program and len(b) >= 4), None)
        if body is None:
            continue
        found.programs.append(program)
        clock = int.from_bytes(body[0:2], "big") & 0x1FFF
        if clock != 0x1FFF and clock not in found.clocks:
            found.clocks[clock] = packets.clocks(clock)
        i = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
        while i + 5 <= len(body):
            stream = int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF
            if stream not in seen:
                seen.add(stream)
                found.streams.append(_read_elementary(packets, Elementary(program, body[i], stream)))
            i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0x0FFF)
    if not found.streams:
        found.table_errors += 1
    return found


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): the UTF-8 text, filled with spaces to a positive multiple of the block."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")


def stored_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for (doc_id, text); media: the transport stream, binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                payloads = [padded(t.as_py()) for t in part.column(1)]
                media = pa.array([write_stream(p) for _, p in payloads], pa.binary())
                columns = [part.column(0), pa.array([n for n, _ in payloads], pa.int64()), media]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_bytes long, media binary")


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, access_points array<long>"


def kept_streams(docs: DataFrame) -> DataFrame:
    """``stored_streams`` written to a table in the shared folder and read back."""
    return stored(stored_streams(docs), "media", compression="zstd")


def read_streams(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with digests and features in place of the media column; all are read back from its bytes."""
    names = [d.split(" ")[0] for d in _DIGEST.split(", ")]
    kept = [c for c in rows.columns if c not in (media, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                out: list[list] = [[] for _ in names]
                for cell in part.column(len(kept)):
                    data = cell.as_py() or b""
                    s = read_stream(data)
                    values = (
                        len(s.payload),
                        hashlib.sha256(s.payload).hexdigest(),
                        zlib.crc32(s.payload[-16:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        s.feature(),
                        s.times,
                        s.access_points,
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                text, number, listed = pa.string(), pa.int64(), pa.list_(pa.int64())
                kinds = (number, text, number, number, text, text, listed, listed)
                arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *arrays], [*kept, *names])

    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{media}`"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != media)
    return rows.mapInArrow(run, schema + _DIGEST)
