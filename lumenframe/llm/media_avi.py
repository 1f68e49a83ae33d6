"""Media columns: motion-JPEG in AVI. Writing, RIFF parsing, intra decoding, shot clips.

A payload is carried losslessly as the quantised coefficients of baseline JPEG frames. The values
of magnitude category 8 are -255..-128 and 128..255, and their 8 appended bits run through 0..255,
so a byte is the appended bits of one coefficient. A Huffman table with one symbol (no zero run,
category 8; code 0) then makes every coefficient 9 bits and every 8x8 block 72 bytes. Three
components of one block make a unit of 192 payload bytes, each closed by a restart marker, which
also resets the DC prediction. Any baseline decoder reads these frames; the payload is exact at
the coefficients, not at the clipped pixels.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import mapped, packed, utf8

UNIT = 192
#: Units in a frame: four blocks side by side, 32 x 8 pixels.
ACROSS = 4
FPS = 5
HISTOGRAM_BINS = 16
#: A cut needs a histogram difference over this floor and over mean + SPREAD * deviation of the others near it.
FLOOR, SPREAD, NEAR = 0.10, 1.5, 8

# Fixed values of the JPEG format: zigzag order of an 8x8 block, by row and column.
_ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


def _inverse_dct() -> np.ndarray:
    """Matrix from 64 zigzag coefficients to 64 samples in row order."""
    scale = lambda k: np.sqrt(0.125) if k == 0 else 0.5
    basis = np.array([[scale(k) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
    return np.array([np.outer(basis[r], basis[c]).ravel() for r, c in _ZIGZAG], np.float32)


_IDCT = _inverse_dct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


#: A table of one code, 0, for no zero run and category 8: codes of each length, and the symbol.
_ONE_CODE = (bytes([1] + [0] * 15), b"\x08")


def _head() -> bytes:
    frame = struct.pack(">BHHB", 8, 8, 8 * ACROSS, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    scan = b"\x03" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + bytes([0, 63, 0])
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, frame) + _segment(0xC4, b"\x00" + b"".join(_ONE_CODE) + b"\x10" + b"".join(_ONE_CODE)) + _segment(0xDD, b"\0\1") + _segment(0xDA, scan)


_HEAD = _head()
_SHIFT = np.arange(8, dtype=np.uint16)


def _pack(payload: bytes) -> np.ndarray:
    """Units as entropy-coded bytes, 216 a unit: a zero bit before each payload byte."""
    b = np.frombuffer(payload, np.uint8).reshape(-1, 8).astype(np.uint16)
    out = np.zeros((len(b), 9), np.uint16)
    out[:, :8] = b >> (_SHIFT + 1)
    out[:, 1:] |= (b << (7 - _SHIFT)) & 255
    return out.astype(np.uint8).reshape(-1, UNIT * 9 // 8)


def _unpack(coded: bytes) -> np.ndarray | None:
    """Appended bits of each coefficient; None if a code other than 0 occurs."""
    c = np.frombuffer(coded, np.uint8).reshape(-1, 9).astype(np.uint16)
    lead = np.empty((len(c), 8), np.uint16)
    lead[:] = (c[:, :8] >> (7 - _SHIFT)) & 1
    if lead.any():
        return None
    return (((c[:, :8] << (_SHIFT + 1)) | (c[:, 1:] >> (7 - _SHIFT))) & 255).astype(np.uint8).reshape(-1, 64)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file whose motion-JPEG frames hold ``payload`` (a positive multiple of 192 bytes)."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    whole = payload + b" " * (-len(payload) % (UNIT * ACROSS))
    units = [u.tobytes().replace(b"\xff", b"\xff\0") for u in _pack(whole)]
    frames = []
    for i in range(0, len(units), ACROSS):
        body = b"".join(u + bytes([255, 0xD0 + k % 8]) for k, u in enumerate(units[i : i + ACROSS]))[:-2]
        frames.append(_HEAD + body + b"\xff\xd9")
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    listing = lambda kind, body: chunk(b"LIST", kind + body)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, 8 * ACROSS, 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, 8 * ACROSS, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * ACROSS, 8, 1, 24, b"MJPG", 8 * ACROSS * 8 * 3, 0, 0, 0, 0)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    head = listing(b"hdrl", chunk(b"avih", avih) + listing(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    note = listing(b"INFO", chunk(b"ICMT", b"payload_bytes=%d" % len(payload)))
    return chunk(b"RIFF", b"AVI " + head + note + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    while lo + 8 <= hi:
        tag, n = data[lo : lo + 4], struct.unpack_from("<I", data, lo + 4)[0]
        yield tag, lo + 8, min(lo + 8 + n, hi)
        lo += 8 + n + n % 2


def parse_avi(data: bytes) -> dict:
    """Frame period, size, comment and frames (bytes) of an AVI file.

    Files of several RIFF segments (OpenDML) are read whole. The frames come by the stream's super
    index and its chunks where it has one; else segment by segment, the first by its ``idx1`` and
    all others, or one whose index does not point at chunks, by walking ``movi`` and the ``rec ``
    lists in it.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"period": 0.0, "width": 0, "height": 0, "comment": b"", "frames": []}
    segments: list[list] = []
    index, chunks = None, []
    for tag, lo, hi in _chunks(data, 0, len(data)):
        if tag != b"RIFF" or data[lo : lo + 4] not in (b"AVI ", b"AVIX"):
            continue
        todo = [(lo + 4, hi)]
        while todo:
            for tag, lo, hi in _chunks(data, *todo.pop()):
                kind = data[lo : lo + 4] if tag == b"LIST" else b""
                if kind == b"movi":
                    segments.append([lo, hi])
                elif kind in (b"hdrl", b"INFO", b"strl"):
                    todo.append((lo + 4, hi))
                elif tag == b"avih":
                    out["period"] = struct.unpack_from("<I", data, lo)[0] / 1e6
                    out["width"], out["height"] = struct.unpack_from("<II", data, lo + 32)
                elif tag == b"ICMT":
                    out["comment"] = data[lo:hi]
                elif tag == b"idx1" and len(segments) == 1:
                    index = (lo, hi)
                elif tag == b"indx" and data[lo + 3 : lo + 4] == b"\0" and data[lo + 10 : lo + 12] in (b"dc", b"db"):
                    n = struct.unpack_from("<I", data, lo + 4)[0]
                    chunks = [struct.unpack_from("<Q", data, lo + 24 + 16 * i)[0] for i in range(n)]
    frames = _by_chunks(data, chunks)
    if frames is None:
        first = _by_index(data, index, segments[0][0]) if index else None
        frames = first or []
        for lo, hi in segments[bool(first) :]:
            frames += _walked(data, lo + 4, hi)
    out["frames"] = frames
    return out


def _by_chunks(data: bytes, chunks: list[int]) -> list[bytes] | None:
    """Frames by OpenDML index chunks; None without any, or if one is not where it should be."""
    frames = []
    for at in chunks:
        if at + 32 > len(data) or data[at + 11 : at + 12] != b"\1":
            return None
        n, tag, base = struct.unpack_from("<I4sQ", data, at + 12)
        if tag[2:] not in (b"dc", b"db") or at + 32 + 8 * n > len(data):
            return None
        for i in range(n):
            offset, size = struct.unpack_from("<II", data, at + 32 + 8 * i)
            frames.append(data[base + offset : base + offset + (size & 0x7FFFFFFF)])
    return frames or None


def _by_index(data: bytes, index: tuple[int, int], movi: int) -> list[bytes] | None:
    """Frames by ``idx1``, whose places count from ``movi`` or from the file's start; None if one is wrong."""
    frames = []
    for lo in range(index[0], index[1] - 15, 16):
        tag, _, at, n = struct.unpack_from("<4sIII", data, lo)
        if tag[2:] not in (b"dc", b"db"):
            continue
        at = next((x for x in (movi + at, at) if data[x : x + 4] == tag), None)
        if at is None:
            return None
        frames.append(data[at + 8 : at + 8 + n])
    return frames


def _walked(data: bytes, lo: int, hi: int) -> list[bytes]:
    frames = []
    for tag, a, z in _chunks(data, lo, hi):
        if tag == b"LIST" and data[a : a + 4] == b"rec ":
            frames += _walked(data, a + 4, z)
        elif tag[2:] in (b"dc", b"db"):
            frames.append(data[a:z])
    return frames


class _Bits:
    """Bits of a scan, eight bytes looked at at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        """The next 16 bits, zeros after the end."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("a scan ends early")
        word = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "big")
        word = word >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return word


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Length of the code and symbol (length * 256 + symbol) by the next 16 bits; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length, c in enumerate(counts, 1):
        for _ in range(c):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _huffman(bits: _Bits, table: np.ndarray) -> int:
    found = int(table[bits.peek()])
    if not found:
        raise ValueError("a code that no table has")
    bits.take(found >> 8)
    return found & 255


# Fixed values of the JPEG format (ITU T.81, K.3 to K.6): codes of each length and the symbols of
# the usual tables, which motion-JPEG frames may leave out. After the symbols stated come all
# others of a run of 0 to 15 zeros and a size of 1 to 10, in order.
_USUAL = {
    0x00: ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: ("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ("00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def _usual_tables() -> dict[int, tuple[bytes, bytes]]:
    out = {}
    for key, (counts, first) in _USUAL.items():
        head = bytes.fromhex(first)
        every = bytes(run << 4 | size for run in range(16) for size in range(1, 11)) if key & 16 else b""
        out[key] = (bytes.fromhex(counts), head + bytes(x for x in every if x not in head))
    return out


_USUAL_TABLES = _usual_tables()


def decode_frame(data: bytes) -> dict:
    """Quantised coefficients of a baseline JPEG frame.

    Returns ``blocks`` (component -> blocks in scan order x 64, zigzag), ``quant`` (component ->
    64 steps), ``size`` (width, height) and ``raw``: the appended bits of all coefficients, if
    the frame is of the one-code kind that ``encode_avi`` writes, else None. A frame without Huffman
    tables has the usual ones. Progressive frames are refused.
    """
    quant: dict[int, np.ndarray] = {}
    codes = dict(_USUAL_TABLES)
    parts: list[tuple[int, int, int, int]] = []
    tables: dict[int, int] = {}
    restart, at, size = 0, 2, (0, 0)
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("a marker was expected")
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                codes[body[0]] = (body[1:17], body[17:n])
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only samples of 8 bits are decoded")
            size = struct.unpack_from(">HH", body, 1)[::-1]
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if not tables or not parts:
        raise ValueError("a frame without a scan")
    end = data.rfind(b"\xff\xd9")
    scan = re.split(rb"\xff[\xd0-\xd7]", data[at : end if end >= at else len(data)])
    used = {codes[k] for t in tables.values() for k in (t >> 4, 16 + (t & 15))}
    if used == {_ONE_CODE} and restart == 1 and all(p[1:3] == (1, 1) for p in parts):
        raw = _unpack(b"".join(s.replace(b"\xff\0", b"\xff") for s in scan))
        if raw is not None:
            values = raw.astype(np.float32)
            values -= 255 * (raw < 128)
            blocks = {p[0]: values[i :: len(parts)] for i, p in enumerate(parts)}
            return {"blocks": blocks, "quant": {p[0]: quant[p[3]] for p in parts}, "size": size, "raw": raw}
    wide, tall = 8 * max(p[1] for p in parts), 8 * max(p[2] for p in parts)
    units = -(-size[0] // wide) * -(-size[1] // tall)
    looked = {k: _lookup(*codes[k]) for t in tables.values() for k in (t >> 4, 16 + (t & 15))}
    got: dict[int, list[list[int]]] = {p[0]: [] for p in parts}
    done = 0
    for piece in scan:
        bits, last = _Bits(piece.replace(b"\xff\0", b"\xff")), {p[0]: 0 for p in parts}
        for _ in range(min(restart or units, units - done)):
            for c, h, v, _q in parts:
                for _ in range(h * v):
                    block = [0] * 64
                    s = _huffman(bits, looked[tables[c] >> 4])
                    x = bits.take(s)
                    last[c] += x if not s or x >> (s - 1) else x - (1 << s) + 1
                    block[0], k = last[c], 1
                    while k < 64:
                        rs = _huffman(bits, looked[16 + (tables[c] & 15)])
                        s, k = rs & 15, k + (rs >> 4)
                        if not s:
                            if rs != 0xF0:
                                break
                            k += 1
                            continue
                        x = bits.take(s)
                        block[k] = x if x >> (s - 1) else x - (1 << s) + 1
                        k += 1
                    got[c].append(block)
            done += 1
    return {"blocks": {c: np.array(b, np.float32).reshape(-1, 64) for c, b in got.items()}, "quant": {p[0]: quant[p[3]] for p in parts}, "size": size, "raw": None}


def luma(frame: dict) -> np.ndarray:
    """Samples of the first component, block by block."""
    c = min(frame["blocks"])
    return np.clip(np.rint((frame["blocks"][c] * frame["quant"][c]) @ _IDCT + 128), 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges (first, last) of shots, by adaptive differences of grey histograms.

    A frame opens a shot if its difference from the one before it is above ``FLOOR``, above the
    mean plus ``SPREAD`` deviations of the other differences within ``NEAR`` frames, and no
    smaller than those next to it.
    """
    n = len(histograms)
    share = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    d = np.concatenate([[0.0], 0.5 * np.abs(np.diff(share, axis=0)).sum(1)]) if n else np.zeros(0)
    cuts = [0] if n else []
    total, square = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    for i in range(1, n):
        if d[i] <= FLOOR or d[i] < max(d[max(i - 1, 1)], d[min(i + 1, n - 1)]):
            continue
        lo, hi = max(1, i - NEAR), min(n, i + NEAR + 1)
        k = hi - lo - 1
        mean = (total[hi] - total[lo] - d[i]) / k if k else 0.0
        deviation = np.sqrt(max((square[hi] - square[lo] - d[i] ** 2) / k - mean**2, 0.0)) if k else 0.0
        if d[i] > mean + SPREAD * deviation:
            cuts.append(i)
    return list(zip(cuts, [c - 1 for c in cuts[1:]] + [n - 1], strict=True)) if n else []


def read_media(data: bytes) -> dict:
    """Payload, frame histograms and shots of a stored file."""
    avi = parse_avi(data)
    decoded = [decode_frame(f) for f in avi["frames"]]
    raw = b"".join(d["raw"].tobytes() for d in decoded if d["raw"] is not None)
    said = re.fullmatch(rb"payload_bytes=(\d+)\0*", avi["comment"])
    grey = [np.bincount(luma(d).ravel() >> 4, minlength=HISTOGRAM_BINS) for d in decoded] if not decoded or decoded[0]["raw"] is None else _histograms(decoded)
    grey = np.array(grey).reshape(-1, HISTOGRAM_BINS)
    return {"payload": raw[: int(said[1])] if said else raw, "histograms": grey, "shots": shots(grey), "period": avi["period"], "size": (avi["width"], avi["height"])}


def _histograms(decoded: list[dict]) -> np.ndarray:
    """Histograms of equally sized frames at once."""
    c = min(decoded[0]["blocks"])
    if len({len(d["blocks"][c]) for d in decoded}) > 1:
        return np.array([np.bincount(luma(d).ravel() >> 4, minlength=HISTOGRAM_BINS) for d in decoded])
    n = len(decoded)
    all_in_one = {"blocks": {c: np.concatenate([d["blocks"][c] for d in decoded])}, "quant": decoded[0]["quant"]}
    level = (luma(all_in_one).reshape(n, -1) >> 4).astype(np.int64) + HISTOGRAM_BINS * np.arange(n)[:, None]
    return np.bincount(level.ravel(), minlength=n * HISTOGRAM_BINS).reshape(n, HISTOGRAM_BINS)


CLIPS = "array<struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double,mean_level:double>>"


def _clips(media: dict) -> list[dict]:
    out = []
    for k, (a, b) in enumerate(media["shots"]):
        h = media["histograms"][a : b + 1].sum(0)
        mean = float((h * np.arange(HISTOGRAM_BINS)).sum() / max(int(h.sum()), 1))
        out.append({"clip": k, "first_frame": a, "last_frame": b, "start_s": round(a * media["period"], 6), "end_s": round((b + 1) * media["period"], 6), "mean_level": round(mean, 6)})
    return out


def clips(files: DataFrame, content: str = "content") -> DataFrame:
    """Clip rows of AVI files (binary column ``content``): ``row`` (the input row) and ``clip``, a row per shot.

    A null, damaged or non-AVI value gives one row with null clip fields and ``error`` set; so
    does a file without frames, with ``error`` null. Repeated rows give their clips each; an empty
    table gives an empty result; other columns, whatever their names, are carried in ``row``.
    """
    p = packed(files, content=F.col(content))
    out = T.StructType([p.schema["row"], *T.StructType.fromDDL(f"clips {CLIPS}, error string")])
    of = to_arrow_schema(T.StructType.fromDDL(f"clips {CLIPS}")).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, errors = [], []
            for x in b.column(1):
                try:
                    got.append(_clips(read_media(x.as_py() or b"")))
                    errors.append(None)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    got.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, of), pa.array(errors, pa.string())], names=["row", "clips", "error"])

    return mapped(p, run, out).select("row", F.explode_outer("clips").alias("clip"), "error")


def digest(text: bytes) -> tuple:
    """The stored form of a text and what is read back from it."""
    payload = text + b" " * (-len(text) % UNIT or UNIT * (not text))
    data = encode_avi(payload)
    media = read_media(data)
    back = media["payload"]
    mean = (media["histograms"].sum(0) * np.arange(HISTOGRAM_BINS)).sum() / media["histograms"].sum()
    cuts = ",".join(f"{c['first_frame']}-{c['last_frame']}@{c['start_s']:.3f}" for c in _clips(media))
    feature = f"{media['size'][0]}x{media['size'][1]};frames={len(media['histograms'])};level={mean:.6f};shots={len(media['shots'])};{hashlib.md5(cuts.encode()).hexdigest()}"
    return (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """Each whole text as an AVI file, read back: ``row`` and the digest columns.

    Defined cases: a null or empty text is stored as 192 blanks; equal texts give equal values;
    a very long text gives a long file, made in memory of a few times its size; repeated rows each
    give a row, an empty table none; other columns, whatever their names, are carried in ``row``.
    """
    p = packed(docs, text=utf8())
    out = T.StructType([p.schema["row"], *T.StructType.fromDDL(DIGEST)])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest(x.as_py()) for x in b.column(1)]
            cols = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["row", *names])

    return mapped(p, run, out)
