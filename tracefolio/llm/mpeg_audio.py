"""Media columns: MPEG audio, Layer III.

``mux`` lays a payload losslessly into a valid elementary stream: an ID3v2.4 tag (it names the payload's length and crc), a
variable-bitrate header frame (frames, bytes, 100 seek points), then mono 48 kHz frames with checksums whose granules have no
coded samples, so that a player hears silence and all main data are ancillary bytes; these carry the payload.

``parse`` reads any stream of MPEG-1, 2 and 2.5 frames with a named bitrate, whoever wrote it: it steps over tags before the audio (ID3v2.2, 2.3
and 2.4) and behind it (ID3v1, APEv2), reads variable-bitrate tables (Xing, Info with an encoder's delay, VBRI), and gives
exact durations and the byte offset of every frame. A header counts, in step, if its checksum is right or another header follows it; a
frame with a wrong checksum is a frame, is named in ``bad`` and counted in ``bad_checksums``. Out of step two headers of one kind
must follow each other (or the audio end), the first with a right checksum, if it has one: so the stream is found again after damage,
and the bytes between are ``skipped``.

Defined results: a null text is empty, and a payload is never empty (padding makes it one unit at least); equal texts give equal
values, byte for byte; every row gives one row where it lies; a very long text is one stream (about 1.02 bytes a byte, in its task's memory); a
damaged stream gives the frames that are whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import DataFrame

from tracefolio.llm.common import doc_texts, map_rows

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3, Layer III), by version: kbit/s by index, Hz by index, samples a frame, bytes of side information (stereo, mono).
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LOW_KBITS = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
SIDE = {False: 32, True: 17}
VERSIONS = {
    3: (KBITS, RATES, SAMPLES, SIDE),  # MPEG-1
    2: (LOW_KBITS, (22050, 24000, 16000), 576, {False: 17, True: 9}),  # MPEG-2
    0: (LOW_KBITS, (11025, 12000, 8000), 576, {False: 17, True: 9}),  # MPEG-2.5
}

UNIT = 192
RATE_INDEX = 1
HEAD = 4 + 2 + SIDE[True]


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The checksum of the format: polynomial x^16 + x^15 + x^2 + 1, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def header(kbits_index: int, rate_index: int = RATE_INDEX, mono: bool = True, protected: bool = True) -> bytes:
    return bytes([0xFF, 0xFA | (not protected), kbits_index << 4 | rate_index << 2, 0xC0 if mono else 0x00])


def frame_start(kbits_index: int) -> bytes:
    """Header, checksum and empty side information of a silent mono frame."""
    head, side = header(kbits_index), bytes(SIDE[True])
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


def frame_bytes(kbits_index: int, rate: int, padding: int = 0) -> int:
    return 144_000 * KBITS[kbits_index] // rate + padding


STARTS = {i: frame_start(i) for i in range(1, 15)}
ROOM = {i: frame_bytes(i, RATES[RATE_INDEX]) - HEAD for i in range(1, 15)}
LARGEST = 14


def id3(texts: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of TXXX frames; sizes are in seven bits a byte."""
    sync = lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
    frames = b""
    for name, value in texts.items():
        body = b"\x03" + name.encode() + b"\x00" + value.encode()
        frames += b"TXXX" + sync(len(body)) + b"\x00\x00" + body
    return b"ID3\x04\x00\x00" + sync(len(frames)) + frames


def mux(payload: bytes, *, tags: dict[str, str] | None = None) -> bytes:
    """The stream that carries ``payload``."""
    full, rest = divmod(len(payload), ROOM[LARGEST])
    frames = [STARTS[LARGEST] + payload[k * ROOM[LARGEST] : (k + 1) * ROOM[LARGEST]] for k in range(full)]
    if rest:
        last = next(i for i, room in ROOM.items() if room >= rest)
        frames.append(STARTS[last] + payload[full * ROOM[LARGEST] :].ljust(ROOM[last], b"\x00"))
    lead_index = 6  # 240 bytes: the table needs 120
    total = frame_bytes(lead_index, RATES[RATE_INDEX]) + sum(map(len, frames))
    ends, at = [], frame_bytes(lead_index, RATES[RATE_INDEX])
    for f in frames:
        ends.append(at)
        at += len(f)
    points = bytes(min(255, ends[len(ends) * k // 100] * 256 // total) if ends else 0 for k in range(100))
    table = b"Xing" + struct.pack(">III", 0x07, len(frames), total) + points
    lead = STARTS[lead_index] + table.ljust(ROOM[lead_index], b"\x00")
    head = id3({"payload_bytes": str(len(payload)), "payload_crc32": str(zlib.crc32(payload))} | (tags or {}))
    return b"".join([head, lead, *frames])


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    points: list[int] = field(default_factory=list)
    delay: int = 0  # samples that an encoder put before and behind, as its table says
    padding: int = 0
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    frame_samples: int = SAMPLES
    rate: int = 0
    bad: list[int] = field(default_factory=list)
    skipped: int = 0
    bitrates: set[int] = field(default_factory=set)
    data: list[bytes] = field(default_factory=list)

    @property
    def bad_checksums(self) -> int:
        return len(self.bad)

    @property
    def duration(self) -> Fraction:
        return Fraction(max(0, self.samples - self.delay - self.padding), self.rate or 1)

    def payload(self) -> bytes:
        return b"".join(self.data)[: int(self.tags.get("payload_bytes", 1 << 62))]


@dataclass(frozen=True)
class Header:
    size: int
    kind: tuple[int, int]  # version, rate: these stay the same throughout a stream
    kbits: int
    samples: int
    start: int  # of what follows the side information
    right: bool  # the checksum; true without one


_SUMS: dict[bytes, int] = {}


def read_header(raw: bytes, at: int, end: int) -> Header | None:
    """The Layer III frame that has its header at ``at`` and lies before ``end``."""
    if at + 4 > end or raw[at] != 0xFF or raw[at + 1] & 0xE6 != 0xE2:
        return None
    b1, b2, mono = raw[at + 1], raw[at + 2], raw[at + 3] >> 6 == 3
    version = b1 >> 3 & 3
    if version == 1 or not 0 < b2 >> 4 < 15 or b2 >> 2 & 3 == 3:
        return None
    kbits, rates, samples, side = VERSIONS[version]
    rate, protected = rates[b2 >> 2 & 3], not b1 & 1
    size = samples * 125 * kbits[b2 >> 4] // rate + (b2 >> 1 & 1)
    start = at + 4 + 2 * protected + side[mono]
    if at + size > end or start > at + size:
        return None
    right = True
    if protected:
        covered = raw[at + 2 : at + 4] + raw[at + 6 : start]
        if len(_SUMS) > 4096:
            _SUMS.clear()
        known = _SUMS.get(covered)
        if known is None:
            known = _SUMS[covered] = crc16(covered)
        right = known == raw[at + 4] << 8 | raw[at + 5]
    return Header(size, (version, rate), kbits[b2 >> 4], samples, start, right)


# --- tags ------------------------------------------------------------------------------------------------------------

CODECS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def sized(b: bytes, bits: int) -> int:
    """A number of ``bits`` bits a byte, most significant first."""
    return sum((x & (1 << bits) - 1) << bits * k for k, x in enumerate(reversed(b)))


def spelled(body: bytes) -> list[str]:
    """The strings of a text frame: a byte that names the encoding, then values with zeros between."""
    codec = CODECS[body[0]] if body and body[0] < 4 else "latin-1"
    parts = body[1:].decode(codec, "replace").split("\x00")
    return [p.removeprefix("\ufeff") for p in parts]


def read_id3v2(raw: bytes, at: int, out: Stream) -> int:
    """Take up the texts of a tag that begins at ``at``; gives its length, 0 if there is none."""
    if raw[at : at + 3] != b"ID3" or len(raw) < at + 10 or raw[at + 3] not in (2, 3, 4):
        return 0
    version, flags, size = raw[at + 3], raw[at + 5], sized(raw[at + 6 : at + 10], 7)
    body, length = raw[at + 10 : at + 10 + size], 10 + size + 10 * (version == 4 and bool(flags & 0x10))
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    name_bytes, head, bits = (3, 6, 8) if version == 2 else (4, 10, 7 if version == 4 else 8)
    p = 0
    if flags & 0x40 and version > 2:
        p = sized(body[:4], bits) + 4 * (version == 3)
    while p + head <= len(body) and body[p]:
        name, n = body[p : p + name_bytes].decode("latin-1"), sized(body[p + name_bytes : p + (6 if version == 2 else 8)], bits)
        texts = spelled(body[p + head : p + head + n]) if name[0] == "T" else []
        if name in ("TXXX", "TXX"):
            out.tags[texts[0]] = texts[1] if len(texts) > 1 else ""
        elif texts:
            out.tags[name] = texts[0]
        p += head + n
    return length


def read_tail(raw: bytes, out: Stream) -> int:
    """Where the audio ends: before an ID3v1 tag and an APEv2 tag, whose texts are taken up where no tag before had them."""
    end = len(raw)
    if end >= 128 and raw[end - 128 : end - 125] == b"TAG":
        old = raw[end - 128 : end]
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            value = old[a:b].split(b"\x00")[0].decode("latin-1").strip()
            if value:
                out.tags.setdefault(name, value)
        end -= 128
    if end >= 32 and raw[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack_from("<III", raw, end - 20)
        first = end - size
        if first >= 0:
            p = first
            for _ in range(count):
                if p + 9 > end - 32:
                    break
                (n,) = struct.unpack_from("<I", raw, p)
                stop = raw.find(b"\x00", p + 8, end)
                if stop < 0:
                    break
                out.tags.setdefault(raw[p + 8 : stop].decode("latin-1"), raw[stop + 1 : stop + 1 + n].decode("utf-8", "replace"))
                p = stop + 1 + n
            end = first - 32 * bool(flags >> 31)
    return max(end, 0)


def read_table(raw: bytes, at: int, h: Header, out: Stream) -> bool:
    """Take up a variable-bitrate table, if the frame is one."""
    body = raw[h.start : at + h.size]
    if body[:4] in (b"Xing", b"Info"):
        (flags,), p = struct.unpack_from(">I", body, 4), 8
        for bit, name in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                setattr(out, name, struct.unpack_from(">I", body, p)[0])
                p += 4
        if flags & 4:
            out.points, p = list(body[p : p + 100]), p + 100
        p += 4 * bool(flags & 8)
        if body[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and len(body) >= p + 24:
            trim = sized(body[p + 21 : p + 24], 8)
            out.delay, out.padding = trim >> 12, trim & 0xFFF
        return True
    if raw[at + 36 : at + 40] == b"VBRI" and h.size >= 62:
        out.table_bytes, out.table_frames, entries, scale, width, _ = struct.unpack_from(">IIHHHH", raw, at + 46)
        jumps = [scale * sized(raw[at + 62 + k * width : at + 62 + (k + 1) * width], 8) for k in range(min(entries, (h.size - 62) // max(width, 1)))]
        out.points = list(accumulate(jumps))
        return True
    return False


def parse(raw: bytes) -> Stream:
    """Frames, tags, tables, durations and offsets of a stream."""
    out, at = Stream(), 0
    while n := read_id3v2(raw, at, out):
        at += n
    end, step = read_tail(raw, out), None

    def follows(at: int, kind: tuple[int, int]) -> bool:
        return at >= end or (h := read_header(raw, at, end)) is not None and h.kind == kind

    while at < end:
        h = read_header(raw, at, end)
        known = h is not None and h.kind == step
        if h and (h.right or known) and (known and h.right or follows(at + h.size, h.kind)):
            step = h.kind
            if out.frames or out.table_frames is not None or not read_table(raw, at, h, out):
                if not h.right:
                    out.bad.append(out.frames)
                out.frames += 1
                out.offsets.append(at)
                out.samples, out.frame_samples, out.rate = out.samples + h.samples, h.samples, h.kind[1]
                out.bitrates.add(h.kbits)
                out.data.append(raw[h.start : at + h.size])
            elif out.table_frames is None:
                out.table_frames = -1  # a table without a count
            at += h.size
            continue
        step = None
        nxt = raw.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        out.skipped += nxt - at
        at = nxt
    return out


def seek(stream: Stream, seconds: Fraction | float) -> int:
    """The byte offset of the frame that sounds at that time."""
    k = int((Fraction(seconds) * stream.rate + stream.delay) / stream.frame_samples)
    return stream.offsets[min(max(k, 0), len(stream.offsets) - 1)]


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """Bytes 32 up to a positive multiple of ``unit``."""
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" ")


def media_column(docs: DataFrame, *, keep_media: bool = False) -> DataFrame:
    """Texts to streams and back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, duration (seconds, a fraction), offsets of all frames (and media)."""

    def start():
        def work(cols: dict) -> list[tuple]:
            out = []
            for doc_id, text in zip(cols["doc_id"], cols["text"]):
                raw = text.encode()
                media = mux(pad(raw))
                s = parse(media)
                got = s.payload()
                if s.table_frames != s.frames or s.skipped or zlib.crc32(got) != int(s.tags["payload_crc32"]):
                    raise ValueError(f"document {doc_id}: the stream does not read back")
                places = zlib.crc32(struct.pack(f"<{len(s.offsets)}I", *s.offsets))
                duration = f"{s.duration.numerator}/{s.duration.denominator}"
                feature = f"frames={s.frames};samples={s.samples};duration={duration};kbits={','.join(map(str, sorted(s.bitrates)))};offsets_crc32={places}"
                row = (doc_id, len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, duration, s.offsets)
                out.append((*row, media) if keep_media else row)
            return out

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration string, offsets array<long>"
    return map_rows(doc_texts(docs), schema + ", media binary" * keep_media, start, batch=64)
