import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import transport_stream as ts


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_any_payload_comes_back(payload):
    media = ts.write_stream(payload)
    assert len(media) % ts.PACKET == 0 and media[:: ts.PACKET] == b"\x47" * (len(media) // ts.PACKET)
    found = ts.read_stream(media)
    assert found.payload == payload
    assert not (found.counter_errors or found.table_errors or found.broken_units)


def test_times_and_access_points():
    found = ts.read_stream(ts.write_stream(bytes(3 * ts._UNIT + 5)))
    assert found.units == 4 and found.times == [0, 3600, 7200, 10800]
    assert len(found.access_points) == 4 and found.access_points[0] == 0
    big = (1 << 33) - 1
    assert ts._time(big)[0] & 1 and ts._time(big) == bytes([0x2F, 0xFF, 0xFF, 0xFF, 0xFF])


def test_damage_is_noticed():
    payload = bytes(range(256)) * 200
    media = ts.write_stream(payload)
    lost = ts.read_stream(media[: 10 * 188] + media[11 * 188 :])
    assert lost.counter_errors == 1 and lost.broken_units == 1 and len(lost.payload) < len(payload)
    twice = ts.read_stream(media[: 11 * 188] + media[10 * 188 :])
    assert twice.payload == payload and twice.counter_errors == 0
    table = bytearray(media)
    table[10] ^= 1
    assert ts.read_stream(bytes(table)).table_errors > 0
    for junk in (b"", b"x" * 999, media[:100], media[: 2 * 188]):
        assert ts.read_stream(junk).payload == b""


class Writer:
    """Packets by hand, as another writer may make them."""

    def __init__(self):
        self.packets, self.counts = [], {}

    def packet(self, pid, body, start, adaptation=None):
        """One packet; ``body`` must fill it, or is filled up by the adaptation field."""
        count = self.counts.get(pid, 0)
        self.counts[pid] = count + 1 & 15
        field = b"" if adaptation is None else bytes([len(adaptation)]) + adaptation
        room = 184 - len(body) - len(field)
        if room:
            # Stuffing: an adaptation field of no more than its length byte, or with flags and filler.
            inside = (adaptation or b"") if adaptation is not None else (b"" if room == 1 else b"\0")
            size = 184 - len(body) - 1
            field = bytes([size]) + inside + b"\xff" * (size - len(inside))
        head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | count])
        self.packets.append(head + field + body)
        assert len(self.packets[-1]) == 188

    def many(self, pid, body, adaptation=None):
        first = min(len(body), 184 if adaptation is None else 183 - len(adaptation))
        self.packet(pid, body[:first], True, adaptation)
        for at in range(first, len(body), 184):
            self.packet(pid, body[at : at + 184], False)

    def sections(self, pid, *sections):
        """Sections one after the other, filled up with 0xFF."""
        body = b"\0" + b"".join(sections)
        body += b"\xff" * (-len(body) % 184)
        for at in range(0, len(body), 184):
            self.packet(pid, body[at : at + 184], at == 0)

    def data(self):
        return b"".join(self.packets)


def program_map(program, clock, streams, note=b""):
    body = (0xE000 | clock).to_bytes(2, "big") + (0xF000 | len(note)).to_bytes(2, "big") + note
    for kind, pid, more in streams:
        body += bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(more)).to_bytes(2, "big") + more
    return ts._section(2, program, body)


def association(*programs):
    return ts._section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in programs))


def elementary(stream_id, payload, pts=None, dts=None, open_length=False):
    flags = (0x80 if pts is not None else 0) | (0x40 if dts is not None else 0)
    times = b"" if pts is None else ts._time(pts)
    if dts is not None:
        times = bytes([times[0] | 0x10]) + times[1:] + bytes([ts._time(dts)[0] & 0x0F | 0x10]) + ts._time(dts)[1:]
    body = bytes([0x80, flags, len(times)]) + times + payload
    return b"\0\0\x01" + bytes([stream_id]) + (0 if open_length else len(body)).to_bytes(2, "big") + body


def test_streams_that_others_write():
    w = Writer()
    long_note = b"\x05\xfa" + bytes(250)
    w.sections(0, association((0, 0x10), (7, 0x30), (9, 0x31)))
    # A section over two packets; then two sections that share a packet.
    w.sections(0x30, program_map(7, 0x50, [(0x1B, 0x50, b""), (0x0F, 0x51, long_note)], long_note))
    w.sections(0x31, ts._section(66, 9, b"other"), program_map(9, 0x1FFF, [(0x06, 0x60, b"\x0a\x01z")]))
    clock = (12345 << 15 | 0x7E00 | 17).to_bytes(6, "big")
    video = [bytes([k]) * (400 + 250 * k) for k in range(4)]
    audio = [bytes([100 + k]) * 300 for k in range(3)]
    for k, payload in enumerate(video):
        w.many(0x50, elementary(0xE0, payload, 9000 * k + 10, 9000 * k, open_length=True), b"\x50" + clock if k % 2 == 0 else None)
        if k < 3:
            w.many(0x51, elementary(0xC0, audio[k], (1 << 33) - 1 - k))
    w.many(0x60, b"\0\0\x01\xbf" + (5).to_bytes(2, "big") + b"plain")
    w.many(0x60, b"\0\0\x01\xbe" + (9).to_bytes(2, "big") + b"\xff" * 9)
    found = ts.read_stream(w.data())
    assert found.programs == [7, 9] and not (found.counter_errors or found.table_errors or found.broken_units)
    first, second, third = found.streams
    assert (first.program, first.kind, first.pid) == (7, 0x1B, 0x50) and found.payload == first.payload == b"".join(video)
    assert first.times == [10, 9010, 18010, 27010] and first.decoding_times == [0, 9000, 18000, 27000]
    assert len(first.access_points) == 2 and found.clocks == {0x50: [12345 * 300 + 17] * 2}
    assert second.payload == b"".join(audio) and second.times == [(1 << 33) - 1, (1 << 33) - 2, (1 << 33) - 3]
    assert (third.program, third.payload, third.units) == (9, b"plain", 2)
    # Bytes before the first packet, and packets that are marked as damaged.
    shifted = ts.read_stream(b"\0junk" + w.data())
    assert shifted.payload == found.payload and shifted.sync_errors == 1
    bad = bytearray(w.data())
    bad[188 * (len(w.packets) - 1) + 1] |= 0x80
    assert ts.read_stream(bytes(bad)).sync_errors == 1


def test_gaps_discontinuities_and_wrong_sizes():
    w = Writer()
    w.sections(0, association((1, 0x30)))
    w.sections(0x30, program_map(1, 0x1FFF, [(0x06, 0x40, b"")]))
    w.many(0x40, elementary(0xBD, b"a" * 500))
    w.counts[0x40] = 9
    w.many(0x40, elementary(0xBD, b"b" * 500), b"\x80")
    w.many(0x40, elementary(0xBD, b"c" * 500)[:-100])
    w.many(0x40, elementary(0xBD, b"d" * 500))
    found = ts.read_stream(w.data())
    # The announced jump is no error; the packet that is shorter than it says is left out.
    assert found.payload == b"a" * 500 + b"b" * 500 + b"d" * 500 and found.counter_errors == 0 and found.broken_units == 1
    # A packet of the program map is lost: its section is, too.
    v = Writer()
    v.sections(0, association((1, 0x30)))
    v.sections(0x30, program_map(1, 0x1FFF, [(0x06, 0x40, bytes(200)), (0x06, 0x41, bytes(200))]))
    lost = ts.read_stream(b"".join(p for i, p in enumerate(v.packets) if i != 2))
    assert lost.streams == [] and lost.table_errors >= 1


def test_stored_media_are_read_back(docs_of, sample_texts):
    docs = docs_of(sample_texts)
    kept = ts.kept_streams(docs)
    assert kept.inputFiles()
    a = sorted(map(tuple, ts.read_streams(kept).collect()))
    assert a == sorted(map(tuple, ts.read_streams(ts.stored_streams(docs)).collect())) and len(a) == len(sample_texts)


def test_section_crc_known_value():
    assert ts.section_crc(b"123456789") == 0x0376E6E7


def test_frames(docs_of, sample_texts):
    rows = sample_texts + [(None, "é" * 7000), (0, sample_texts[0][1])]
    found = ts.read_streams(ts.stored_streams(docs_of(rows, ", media string, feature string"))).collect()
    expected = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        expected.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    by_text = {}
    for r in found:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert ts.stored_streams(docs_of(rows).limit(0)).collect() == []
