"""GIF media columns: decode LZW code streams into timed frames, and store samples as GIF.

``decode_gif`` reads GIF87a and GIF89a: global and local palettes, interlacing,
transparency, delays and disposal (keep, restore background, restore previous).
``read_frames`` stores each frame's time, place, composed RGBA pixels and colour
histogram as columns. ``text_media`` keeps a payload losslessly as 8-bit samples,
64 wide, in frames of up to 1024 rows with an identity grey palette, LZW coded;
``media_features`` reads the stored bytes back through the same decoder and the same
composed, timed frames.

Canvases are composed in strips of whole rows of up to ``STRIP_PIXELS`` pixels, so
memory is bounded whatever a header says; code streams are decoded block by block,
once for each strip. A canvas of one strip, the usual case, gives a row per frame,
a larger one a row per strip and frame (``strip_top``, ``strip_rows``).

Nulls: a null text is an empty one (a payload of 64 zero bytes); null media give
null features and no frames. Broken media give no frames but one row with
``error`` set. Ids pass through, null or repeated. Very long texts become many
frames and are decoded frame by frame. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, ROWS, DELAY_CS = 64, 1024, 10
BINS = 16
#: Pixels of a canvas that are held at once.
STRIP_PIXELS = 1 << 22
FULL = 4096


def _widths(n: int, bits: int) -> np.ndarray:
    """Bits of the first ``n`` codes behind a clear code (its own follow the first entry of the table)."""
    entries = (1 << bits) + 1 + np.arange(n)
    return np.clip(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, bits + 1, 12)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bit = np.arange(12)
    bits = (codes[:, None] >> bit & 1).astype(np.uint8)
    return np.packbits(bits[bit < widths[:, None]], bitorder="little").tobytes()


def lzw_encode(samples: bytes) -> bytes:
    """8-bit samples as a GIF code stream (without sub-blocks); a clear code follows a full table."""
    clear, end = 256, 257
    out: list[int] = [clear]
    widths, begun = [np.array([9])], 1
    known: dict[int, int] = {}
    get, put, n = known.get, out.append, 258
    p = samples[0] if samples else None
    for c in samples[1:]:
        k = p << 8 | c
        q = get(k)
        if q is not None:
            p = q
            continue
        put(p)
        known[k] = n
        n += 1
        p = c
        if n == FULL:
            put(clear)
            widths.append(_widths(len(out) - begun, 8))
            begun = len(out)
            known.clear()
            n = 258
    if p is not None:
        put(p)
    put(end)
    widths.append(_widths(len(out) - begun, 8))
    return _pack(np.array(out), np.concatenate(widths))


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """Samples of a code stream, ``most`` at most; ValueError if a code has no meaning."""
    return b"".join(lzw_blocks(stream, bits, most))


def lzw_blocks(stream: bytes, bits: int, most: int) -> Iterator[bytes]:
    """The samples of ``lzw_decode`` in blocks of a few thousand codes."""
    clear, end = 1 << bits, (1 << bits) + 1
    plain = [bytes([i]) for i in range(clear)] + [b"", b""]
    flat = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    at, size = 0, 0
    table, prev = plain[:], b""
    done, read = False, 0  # codes read since the clear code
    while not done and at < len(flat) and size < most:
        widths = _widths(read + FULL, bits)[read:]
        ends = at + np.cumsum(widths)
        fit = int(np.searchsorted(ends, len(flat), "right"))
        if not fit:
            break
        starts, widths = (ends - widths)[:fit], widths[:fit]
        codes = np.zeros(fit, np.int64)
        for i in range(12):
            use = i < widths
            codes[use] |= flat[starts[use] + i].astype(np.int64) << i
        stop = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stop[0]) if len(stop) else fit
        out: list[bytes] = []
        put, grow, n = out.append, table.append, len(table)
        for code in codes[:upto].tolist():
            if code < n:
                entry = table[code]
                if prev and n < FULL:
                    grow(prev + entry[:1])
                    n += 1
            elif code == n and prev and n < FULL:
                entry = prev + prev[:1]
                grow(entry)
                n += 1
            else:
                raise ValueError("code without meaning")
            put(entry)
            prev = entry
        size += sum(map(len, out))
        read += upto
        if len(stop):
            at = int(ends[upto])
            done = bool(codes[upto] == end)
            table, prev, read = plain[:], b"", 0
        else:
            at = int(ends[fit - 1])
        block = b"".join(out)
        yield block[: len(block) - max(0, size - most)]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    interlaced: bool
    bits: int
    stream: bytes

    def rows(self, first: int, last: int) -> np.ndarray:
        """Palette indices of the frame's rows from ``first`` to before ``last``."""
        w, h = self.width, self.height
        out, place, rest = np.zeros((max(0, last - first), w), np.uint8), 0, b""
        order = _interlaced(h) if self.interlaced else None
        for block in lzw_blocks(self.stream, self.bits, w * h):
            rest = rest + block if rest else block
            n = len(rest) // w if w else 0
            if n:
                pixels = np.frombuffer(rest, np.uint8, n * w).reshape(n, w)
                at = np.arange(place, place + n) if order is None else order[place : place + n]
                use = (at >= first) & (at < last)
                out[at[use] - first] = pixels[use]
                place, rest = place + n, rest[n * w :]
        if w and place < h:
            raise ValueError("too few samples")
        return out


@dataclass
class Gif:
    width: int
    height: int
    data: bytes
    at: int
    common: np.ndarray | None

    @property
    def frames(self) -> Iterator[Frame]:
        return _frames(self.data, self.at, self.common)


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise ValueError("cut short")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _interlaced(height: int) -> np.ndarray:
    """The rows in the order of an interlaced stream: every 8th from 0, from 4, every 4th from 2, every 2nd from 1."""
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _frames(data: bytes, at: int, common: np.ndarray | None) -> Iterator[Frame]:
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            block, at = _sub_blocks(data, at + 2)
            if kind == 0xF9:
                flags, delay, index = struct.unpack("<BHB", block[:4])
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, palette = at + 10, common
            if flags & 0x80:
                palette, at = _palette(data, at, flags)
            if palette is None:
                raise ValueError("no palette")
            bits = data[at]
            if not 1 <= bits <= 8:
                raise ValueError("code size")
            stream, at = _sub_blocks(data, at + 1)
            yield Frame(left, top, w, h, delay, disposal, transparent, palette, bool(flags & 0x40), bits, stream)
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block")


def decode_gif(data: bytes) -> Gif:
    """Header at once, frames as they are read; ValueError or IndexError if the data are broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    return Gif(width, height, data, at, common)


def colours(frame: Frame, pixels: np.ndarray) -> np.ndarray:
    """A frame's pixels as RGBA; indices beyond the palette are black."""
    palette = np.zeros((256, 4), np.uint8)
    palette[: len(frame.palette), :3], palette[:, 3] = frame.palette, 255
    if frame.transparent is not None:
        palette[frame.transparent, 3] = 0
    return palette[pixels]


@dataclass
class Shown:
    """A strip of the canvas while a frame stands; ``drawn`` is the frame's own area of it, changed or not."""

    frame: Frame
    frame_no: int
    start_ms: int
    strip_top: int
    canvas: np.ndarray
    drawn: np.ndarray


def compose(gif: Gif) -> Iterator[Shown]:
    """The canvas as shown with each frame: palettes, transparency and disposal applied, strip by strip."""
    high = max(1, STRIP_PIXELS // max(1, gif.width))
    for strip_top in range(0, max(1, gif.height), high):
        canvas, start = np.zeros((min(high, gif.height - strip_top), gif.width, 4), np.uint8), 0
        for no, frame in enumerate(gif.frames):
            before = canvas.copy() if frame.disposal == 3 else None
            first = max(0, strip_top - frame.top)
            last = max(first, min(frame.height, strip_top + len(canvas) - frame.top))
            y = frame.top + first - strip_top
            area = canvas[y : y + last - first, frame.left : frame.left + frame.width] if last > first else canvas[:0]
            drawn = colours(frame, frame.rows(first, last))[:, : area.shape[1]]
            if frame.transparent is None:
                area[:] = drawn
            else:
                area[drawn[..., 3] > 0] = drawn[drawn[..., 3] > 0]
            yield Shown(frame, no, start, strip_top, canvas, area)
            start += frame.delay_cs * 10
            if frame.disposal == 2:
                area[:] = 0
            elif before is not None:
                canvas = before


def histogram(rgba: np.ndarray) -> list[list[int]]:
    """Counts of the opaque pixels' red, green and blue in 16 bins each."""
    seen = rgba[rgba[..., 3] > 0]
    return [np.bincount(seen[:, i] >> 4, minlength=BINS).tolist() for i in range(3)]


def read_frames(media: DataFrame, *, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, frame_no, start_ms, delay_ms, place, canvas size, strip, rgba, red/green/blue histograms, error; a column that clashes with the id's gets ``frame_`` in front."""
    rows = media.select(F.col(id_col).cast("string").alias("media_id"), F.col(media_col).alias("media")).filter("media is not null")
    schema = "media_id string, frame_no int, start_ms long, delay_ms long, left int, top int, width int, height int, strip_top int, strip_rows int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for media_id, data in zip(pdf["media_id"], pdf["media"]):
                start, no = 0, 0
                try:
                    gif = decode_gif(bytes(data))
                    for x in compose(gif):
                        red, green, blue = histogram(x.canvas)
                        yield pd.DataFrame([[media_id, x.frame_no, x.start_ms, x.frame.delay_cs * 10, x.frame.left, x.frame.top, gif.width, gif.height, x.strip_top, len(x.canvas), x.canvas.tobytes(), red, green, blue, None]], columns=names)
                        start, no = x.start_ms + x.frame.delay_cs * 10, x.frame_no + 1
                except (ValueError, IndexError, struct.error) as e:
                    yield pd.DataFrame([[media_id, no, start, *[None] * 11, str(e) or "cut short"]], columns=names)

    out = rows.mapInPandas(run, schema)
    named = F.col("media_id").cast(media.schema[id_col].dataType).alias(id_col)
    return out.select(named, *[F.col(c).alias(f"frame_{c}" if c.lower() == id_col.lower() else c) for c in names[1:]])


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64; the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def encode_gif(payload: bytes) -> bytes:
    grey = bytes(v for i in range(256) for v in (i, i, i))
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), grey]
    for at in range(0, rows, ROWS):
        h = min(ROWS, rows - at)
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, h, 0) + b"\x08")
        stream = lzw_encode(payload[at * WIDTH : (at + h) * WIDTH])
        parts += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


def text_media(text: Column) -> Column:
    """The stored form of a text's payload."""

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_gif(payload_of(t)[0]) for t in texts], dtype=object)

    return store(text)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features_of(media: bytes) -> tuple:
    """Digests of the frames as composed (the samples are their red values), and their number, time and summed histogram."""
    sha, n, tail, frames, ms = hashlib.sha256(), 0, b"", 0, 0
    bins = np.zeros(BINS, np.int64)
    for x in compose(decode_gif(media)):
        samples = x.drawn[..., 0].tobytes()
        sha.update(samples)
        n, tail, frames, ms = n + len(samples), (tail + samples)[-WIDTH:], max(frames, x.frame_no + 1), max(ms, x.start_ms + 10 * x.frame.delay_cs)
        bins += histogram(x.drawn)[0]
    return n, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"frames={frames};ms={ms};hist={','.join(map(str, bins))}"


def media_features(media: Column) -> Column:
    """Struct ``FEATURES`` from stored bytes: the samples are decoded, not taken from the text.

    Null media have null features. Media that are broken or no GIF have their own size
    and digest, and ``error:`` with the reason as feature; the rest is null.
    """

    def one(media: bytes) -> tuple:
        try:
            return features_of(media)
        except (ValueError, IndexError, KeyError, struct.error, MemoryError) as e:
            return None, None, None, len(media), hashlib.sha256(media).hexdigest(), f"error: {e}"

    @F.pandas_udf(FEATURES)
    def features(stored: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 6 if m is None else one(bytes(m)) for m in stored]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FEATURES.split(", ")])

    return features(media)


def store_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (binary)."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text_media(text).alias("media"))
