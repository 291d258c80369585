"""GIF media columns: code streams, palettes, disposal and transparency, timed frames, histograms.

``decode`` reads a GIF and renders its frames in order: every frame is drawn with its own or the
global palette, transparent samples leave what is below, and before the next frame the rectangle is
kept (disposal 0 and 1), cleared (2) or put back (3). ``encode`` stores 8-bit samples, 64 a row and
``FRAME_ROWS`` rows a frame, as LZW code streams under a grey palette, so that a rendered channel
is the samples again. A comment holds the number of bytes before padding.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialise, whole_text

WIDTH = 64
FRAME_ROWS = 1024
DELAY = 10  # hundredths of a second
MOST_CODES = 4096
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray  # height x width x 4 of the whole screen, as it shows

    def drawn(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


# --- code streams ---


def _widths(first: int, n: int, size: int) -> np.ndarray:
    """Bits of codes ``first`` .. ``first + n`` after a clear code, for a minimum code size."""
    known = np.minimum(np.arange(first, first + n) + (1 << size) + 1, MOST_CODES - 1)
    return np.maximum(size + 1, np.frexp(known)[1])


def lzw_encode(data: bytes) -> bytes:
    """One clear code, then codes over a table that stays as it is once it has 4096 entries."""
    table: dict[int, int] = {}
    find, codes, size = table.get, [], 258
    out = codes.append
    rest = iter(data)
    at = next(rest)
    for byte in rest:
        if (code := find(key := at << 8 | byte)) is not None:
            at = code
        else:
            out(at)
            at = byte
            if size < MOST_CODES:
                table[key] = size
                size += 1
    out(at)
    out(257)
    values = np.array([256, *codes], "<u2")
    widths = np.concatenate([[9], _widths(0, len(codes), 8)])
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int, most: int) -> bytes:
    """Samples of a code stream with minimum code size ``size``; stops at the end code or ``most`` samples."""
    clear, end = 1 << size, (1 << size) + 1
    single = [bytes((i,)) for i in range(clear)] + [b"", b""]
    bits = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"), np.zeros(12, np.uint8)])
    total, at, seen, made = len(data) * 8, 0, 0, 0
    table, before, out = single[:], b"", []
    while at < total and made < most:
        widths = _widths(seen, min(MOST_CODES, (total - at) // (size + 1) + 1), size)
        places = at + np.concatenate([[0], np.cumsum(widths)])
        n = int(np.searchsorted(places[1:], total, side="right"))
        if not n:
            break
        taps = np.minimum(places[:n, None] + np.arange(12), total)
        codes = (bits[taps] * (np.arange(12) < widths[:n, None])) @ (1 << np.arange(12))
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        known, part = len(table), []
        for code in codes[:stop].tolist():
            if code < known:
                entry = table[code]
            elif before and code == known:
                entry = before + before[:1]
            else:
                raise ValueError("a code that is not in the table yet")
            if before and known < MOST_CODES:
                table.append(before + entry[:1])
                known += 1
            part.append(entry)
            before = entry
        out.append(b"".join(part))
        made += len(out[-1])
        if stop < n:
            if codes[stop] == end:
                break
            at, seen, table, before = int(places[stop + 1]), 0, single[:], b""
        else:
            at, seen = int(places[n]), seen + n
    return b"".join(out)[:most]


# --- files ---


def _sub_blocks(data: bytes) -> bytes:
    parts = [data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(bytes((len(p),)) + p for p in parts) + b"\x00"


def encode(text: bytes) -> bytes:
    """The bytes of a text, filled up with zeros to a positive multiple of 64, as a GIF."""
    payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    out.append(b"!\xfe" + _sub_blocks(b"bytes=%d" % len(text)))
    for top in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - top)
        out.append(b"!\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0))
        out.append(b"," + struct.pack("<HHHHB", 0, 0, WIDTH, n, 0) + b"\x08")
        out.append(_sub_blocks(lzw_encode(payload[top * WIDTH : (top + n) * WIDTH])))
    return b"".join(out) + b";"


def _read_sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 * (2 << (flags & 7))
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def decode(data: bytes) -> tuple[list[Frame], list[bytes]]:
    """The rendered frames and the comments of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    common, at = _palette(data, 13, flags) if flags & 0x80 else (None, 13)
    canvas = np.zeros((height, width, 4), np.uint8)
    frames, comments = [], []
    delay = disposal = 0
    transparent = None
    while data[at : at + 1] not in (b";", b""):
        kind = data[at : at + 1]
        if kind == b"!":
            label = data[at + 1]
            body, at = _read_sub_blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            elif label == 0xFE:
                comments.append(body)
            continue
        if kind != b",":
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        palette, at = _palette(data, at + 10, flags) if flags & 0x80 else (common, at + 10)
        if palette is None:
            raise ValueError("a frame without a palette")
        size = data[at]
        stream, at = _read_sub_blocks(data, at + 1)
        samples = np.zeros(w * h, np.uint8)
        got = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8)
        samples[: len(got)] = got
        samples = samples.reshape(h, w)
        if flags & 0x40:
            order = [y for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, b)]
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        below = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        shown = np.concatenate([palette[samples], np.full((h, w, 1), 255, np.uint8)], axis=2)[: box.shape[0], : box.shape[1]]
        if transparent is None:
            box[:] = shown
        else:
            seen = samples[: box.shape[0], : box.shape[1]] != transparent
            box[seen] = shown[seen]
        frames.append(Frame(left, top, w, h, delay, disposal, transparent, canvas.copy()))
        if disposal == 2:
            box[:] = 0
        elif disposal == 3:
            canvas = below
        delay = disposal = 0
        transparent = None
    return frames, comments


def read_media(data: bytes) -> tuple[tuple[list[Frame], list[bytes]], str | None]:
    """``decode``, and None; or nothing and the reason why these are not the bytes of a GIF."""
    try:
        return decode(data), None
    except (ValueError, IndexError, struct.error) as damage:
        return ([], []), f"{type(damage).__name__}: {damage}"


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels in 4 x 4 x 4 boxes of red, green and blue."""
    seen = pixels[pixels[..., 3] > 0][:, :3].astype(np.int64) >> 6
    return np.bincount(seen @ np.array([16, 4, 1]), minlength=64)


# --- columns ---


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``media``: each whole text as a GIF. Null texts are empty; other columns go."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 500):
                part = frame.iloc[i : i + 500]
                yield pd.DataFrame({"k": part["k"], "media": [encode(t.encode()) for t in part["t"]]})

    rows = docs.select(F.col(key).cast("string").alias("k"), whole_text(text).alias("t"))
    return rows.mapInPandas(make, "k string, media binary").select(F.col("k").cast("long").alias(key), "media")


def frame_columns(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per frame of each GIF: its place in time, its rectangle and rules, its histogram and RGBA pixels, and ``error``.

    Null media have no frames. Media that cannot be decoded give one row with the reason in ``error`` and nulls elsewhere.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for k, data in zip(batch["k"], batch["m"], strict=True):
                at, out = 0, []
                shown, error = read_media(data)
                for i, f in enumerate(shown[0]):
                    out.append((k, i, at, f.delay, f.disposal, f.transparent, f.left, f.top, f.width, f.height, histogram(f.canvas).tolist(), f.canvas.tobytes(), None))
                    at += f.delay
                if error:
                    out.append((k, *[None] * 11, error))
                made = pd.DataFrame(out, columns=["k", *numbers[:1], "start", *numbers[1:], "histogram", "pixels", "error"])
                yield made.astype(dict.fromkeys([*numbers, "start"], "Int32"))

    numbers = ["frame", "delay", "disposal", "transparent", "left", "top", "width", "height"]

    rows = media.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(column).alias("m"))
    made = rows.mapInPandas(read, "k string, frame int, start int, delay int, disposal int, transparent int, left int, top int, width int, height int, histogram array<long>, pixels binary, error string")
    return made.withColumn(key, F.col("k").cast("long")).select(key, *[c for c in made.columns if c != "k"])


def stored_digests(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Per stored text, from its rendered frames: sizes, digests of samples and of the stored form, and a colour feature.

    ``feature``: counts of pixels by colour box over all frames, as ``box:count`` of the boxes in use,
    and the duration. ``timeline``: each frame's place in time, duration (hundredths of a second) and counts by colour box. Media
    that cannot be decoded, or were not stored by ``store_texts``, have the reason in ``error`` and nulls elsewhere.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            out = []
            for k, data in zip(batch["k"], batch["m"], strict=True):
                (shown, comments), error = read_media(data)
                sizes = [int(c[6:]) for c in comments if c.startswith(b"bytes=")]
                if error or not sizes:
                    out.append((k, *[None] * (len(names) - 1), error or "no stored text"))
                    continue
                payload = b"".join(f.drawn()[..., 0].tobytes() for f in shown)
                boxes = [histogram(f.drawn()) for f in shown]
                counts, starts = sum(boxes), np.cumsum([0, *(f.delay for f in shown)]).tolist()
                timeline = [{"frame": i, "start": starts[i], "delay": f.delay, "histogram": boxes[i].tolist()} for i, f in enumerate(shown)]
                feature = " ".join(f"{i}:{counts[i]}" for i in np.flatnonzero(counts)) + f" {sum(f.delay for f in shown)}cs"
                out.append((k, sizes[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(shown), timeline, None))
            made = pd.DataFrame(out, columns=["k", *names])
            yield made.astype({n: "Int64" for n, kind in zip(names, kinds, strict=True) if kind == "long"})

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "timeline", "error"]
    kinds = ["long", "long", "string", "long", "long", "string", "string", "long", "array<struct<frame: int, start: int, delay: int, histogram: array<long>>>", "string"]
    rows = media.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(column).alias("m"))
    made = rows.mapInPandas(read, "k string, " + ", ".join(map(" ".join, zip(names, kinds, strict=True))))
    return made.select(F.col("k").cast("long").alias(key), *names)


def text_media(docs: DataFrame) -> DataFrame:
    """Stores all texts as GIFs in a table in the shared folder, reads it back and describes each.

    Null and empty texts are one row of zeros; repeated rows and null keys are kept; an empty table
    gives an empty result.
    """
    return stored_digests(materialise(store_texts(docs), "gif-media"))
