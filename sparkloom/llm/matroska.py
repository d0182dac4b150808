"""Media columns: Matroska files written to and parsed into packet tables.

A Matroska file is a tree of EBML elements: an id and a size, both variable-length integers, and a
body. Clusters hold a base timestamp and blocks; a block holds one frame, or several that are laced.
``mux`` writes 8-bit PCM samples into such a file, ``demux`` parses any Matroska file into tracks,
packets (track, timestamp, byte range) and cues without copying frames, and ``payload`` joins a
track's byte ranges again. The work is per row, so no shuffle is needed and a lost executor costs only
its own tasks.

Defined results: a null or empty text becomes one unit of padding; very long texts become more
clusters; repeated rows give equal values; an empty table gives no row; extra input columns are ignored. A file that is cut short or damaged yields what
was read up to there, whole packets only; bytes that don't begin as EBML raise ``ValueError`` in ``demux`` and have no packets in a table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import namedtuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_map

# Fixed values of the container format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUX_APP, WRITE_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
ENTRY, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_NS = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
INSIDE = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, CUE_AT}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

UNIT = 192  # bytes; at 48 kHz and 8 bits exactly 4 ms
HZ = 48_000
FRAME = 8 * UNIT
LACED = 8  # frames in a block
BLOCKS = 64  # blocks in a cluster: 16.4 s, within a block's signed 16-bit timestamp

Packet = namedtuple("Packet", "track timestamp_ns offset length keyframe lacing cluster")
Media = namedtuple("Media", "tracks packets cues clusters duration_ns")


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << (7 * k)) - 1:
        k += 1
    return ((1 << (7 * k)) | n).to_bytes(k, "big")


def _el(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _el(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return _el(ident, struct.pack(">d", x))


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing kind and the bytes that follow a block's flags."""
    if len(frames) == 1:
        return NO_LACE, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return FIXED, bytes([len(frames) - 1]) + b"".join(frames)
    head = bytes([len(frames) - 1]) + _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        d, k = b - a, 1
        while not -(1 << (7 * k - 1)) < d < (1 << (7 * k - 1)):
            k += 1
        head += ((1 << (7 * k)) | (d + (1 << (7 * k - 1)) - 1)).to_bytes(k, "big")
    return EBML_LACE, head + b"".join(frames)


def mux(samples: bytes) -> bytes:
    """A Matroska file with one 8-bit PCM track; ``samples`` is a positive multiple of ``UNIT`` bytes."""
    header = _el(EBML, _uint(VERSION, 1) + _uint(READ_VERSION, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + _el(DOCTYPE, b"matroska") + _uint(DOCTYPE_VERSION, 4) + _uint(DOCTYPE_READ, 2))
    ms = lambda n: n * 1000 // HZ
    info = _el(INFO, _uint(SCALE, 1_000_000) + _float(DURATION, float(ms(len(samples)))) + _el(MUX_APP, b"sparkloom") + _el(WRITE_APP, b"sparkloom"))
    audio = _el(AUDIO, _float(RATE, float(HZ)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    track = _el(TRACKS, _el(ENTRY, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACING, 1) + _uint(DEFAULT_NS, FRAME * 1_000_000_000 // HZ) + _el(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, track], b"", len(info) + len(track)
    span = FRAME * LACED
    for start in range(0, len(samples), span * BLOCKS):
        base, blocks = ms(start), []
        for b in range(start, min(start + span * BLOCKS, len(samples)), span):
            kind, body = _lace([samples[i : min(i + FRAME, b + span)] for i in range(b, min(b + span, len(samples)), FRAME)])
            blocks.append(_el(SIMPLE, b"\x81" + struct.pack(">hB", ms(b) - base, 0x80 | kind << 1) + body))
        cluster = _el(CLUSTER, _uint(TIME, base) + b"".join(blocks))
        cues += _el(POINT, _uint(CUE_TIME, base) + _el(CUE_AT, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at)))
        parts.append(cluster)
        at += len(cluster)
    return header + _el(SEGMENT, b"".join(parts) + _el(CUES, cues))


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length integer and the position after it; -1 is the unknown size."""
    first = data[at]
    if not first:
        raise ValueError("an EBML integer of over 8 bytes")
    k = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + k], "big")
    if keep:
        return raw, at + k
    n = raw & ((1 << (7 * k)) - 1)
    return (-1 if n == (1 << (7 * k)) - 1 else n), at + k


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, length) of each frame from ``at``, just after a block's flags."""
    if kind == NO_LACE:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind not in (XIPH, FIXED, EBML_LACE):
        raise ValueError("no such lacing")
    if kind == XIPH:
        for _ in range(n - 1):
            s = 0
            while data[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + data[at])
            at += 1
    elif kind == EBML_LACE:
        for i in range(n - 1):
            width = 9 - data[at].bit_length()
            v, at = _vint(data, at)
            sizes.append(v if not i else sizes[-1] + v - ((1 << (7 * width - 1)) - 1))
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at > end:
        raise ValueError("frames are longer than their block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def demux(data: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file. Timestamps are in ns; offsets are of the file."""
    if data[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("not a Matroska file")
    media = Media([], [], [], [], [0])
    try:
        _parse(data, media)
    except (IndexError, struct.error, ValueError, OverflowError):
        pass  # what was read up to here stands
    return media._replace(duration_ns=media.duration_ns[0])


def _parse(data: bytes, media: Media) -> None:
    """Read all elements into ``media``; its duration is the one element of a list."""
    tracks, packets, cues, clusters, _ = media
    scale, duration = 1_000_000, 0.0
    num = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    at, base, segment = 0, 0, 0
    while at < len(data):
        start = at
        ident, body = _vint(data, at, True)
        n, body = _vint(data, body)
        end = len(data) if n < 0 else body + n
        if ident in INSIDE:
            at = body
            if ident == SEGMENT:
                segment = body
            elif ident == CLUSTER:
                clusters.append(start - segment)
            elif ident == ENTRY:
                tracks.append({})
            elif ident == POINT:
                cues.append({})
            continue
        if end > len(data):
            return
        at = end
        if ident == SCALE:
            scale = num(body, end)
        elif ident == DURATION:
            duration = real(body, end)
        elif ident in (NUMBER, UID, KIND, CHANNELS, DEPTH, DEFAULT_NS) and tracks:
            tracks[-1][ident] = num(body, end)
        elif ident == RATE and tracks:
            tracks[-1][RATE] = real(body, end)
        elif ident == CODEC and tracks:
            tracks[-1][CODEC] = data[body:end].decode("ascii", "replace")
        elif ident == TIME:
            base = num(body, end)
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER) and cues:
            cues[-1][ident] = num(body, end)
        elif ident in (SIMPLE, BLOCK):
            track, p = _vint(data, body)
            rel, flags = struct.unpack(">hB", data[p : p + 3])
            if p + 3 > end:
                raise ValueError("a block without a header")
            kind, step = flags >> 1 & 3, next((t.get(DEFAULT_NS, 0) for t in tracks if t.get(NUMBER) == track), 0)
            frames = _frames(data, p + 3, end, kind)
            if not 0 <= (base + rel) * scale + len(frames) * step < 1 << 63:
                raise ValueError("a time beyond 64 bits")
            for i, (o, s) in enumerate(frames):
                packets.append(Packet(track, (base + rel) * scale + i * step, o, s, bool(flags & 0x80) or ident == BLOCK, kind, len(clusters) - 1))
        if duration == duration and 0 <= duration * scale < 1 << 63:
            media.duration_ns[0] = int(duration * scale)


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's frames, joined in file order."""
    view = memoryview(data)
    return b"".join(view[p.offset : p.offset + p.length] for p in media.packets if p.track == track)


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b" " * (-len(raw) % unit or (0 if raw else unit))


def features(samples: bytes, media: Media) -> str:
    """Figures of the samples read back and of the container: levels, crossings, packets, clusters, cues."""
    x = np.frombuffer(samples, np.uint8)
    hist = np.bincount(x, minlength=256)
    levels, n = np.arange(256.0), len(x)
    mean = float(hist @ levels) / n
    rms = float(np.sqrt(max(0.0, float(hist @ levels**2) / n - mean * mean)))
    p = hist[hist > 0] / n
    above = x >= 128
    return (
        f"pcm8;hz={int(media.tracks[0][RATE])};ms={media.duration_ns // 1_000_000};packets={len(media.packets)};clusters={len(media.clusters)};"
        f"cues={len(media.cues)};mean={mean:.4f};rms={rms:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};peak={int(x.max())};crossings={int((above[1:] != above[:-1]).sum())}"
    )


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes stored as a Matroska file, read back, checked and measured.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """

    def start():
        def step(rows):
            out = []
            for doc, text in rows:
                raw = (text or "").encode()
                stored = mux(pad(raw))
                media = demux(stored)
                back = payload(stored, media)
                out.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, media)))
            return out

        return step

    return text_map(
        docs.select(F.col(id_col), F.col(text_col)), start,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(media_id, media): each text's bytes as a Matroska file."""
    return text_map(docs.select(F.col(id_col), F.col(text_col)), lambda: lambda rows: [(i, mux(pad((t or "").encode()))) for i, t in rows], "media_id long, media binary", rows=64)


def packet_table(media: DataFrame, id_col: str = "media_id", bytes_col: str = "media") -> DataFrame:
    """One row per packet of each binary Matroska value; null values and those that are no such file have none."""
    begins = EBML.to_bytes(4, "big")

    def start():
        return lambda rows: [(i, n, *p) for i, data in rows if data is not None and bytes(data[:4]) == begins for n, p in enumerate(demux(bytes(data)).packets)]

    return text_map(media.select(id_col, bytes_col), start, "media_id long, packet long, track long, timestamp_ns long, byte_offset long, byte_length long, keyframe boolean, lacing int, cluster int", rows=16)
