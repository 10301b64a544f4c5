"""Media columns: texts or other bytes kept as GIF files, and features of decoded GIF files.

write_gif() stores bytes losslessly as palette indices of frames; read_frames() is a decoder for any GIF: code streams,
global and local palettes, interlacing, transparency, disposal and delays. features() turns a column of files into
frames and colour histograms.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import slices

#: Width of the frames that payloads are stored in; payloads are padded with spaces to a multiple of it.
WIDTH = 192
#: Rows of a frame at most, and hundredths of a second that it is shown.
ROWS, DELAY = 2048, 10
#: Levels of each colour channel in histograms.
LEVELS = 4
#: Texts that a worker handles at a time.
BATCH = 200


# --- code streams -----------------------------------------------------------------------------------------------


@lru_cache
def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each code of a run between two clear codes, and where it starts: one more bit whenever the table has outgrown the present width."""
    entries = np.maximum((1 << bits) + np.arange(4097), 1 << bits)
    entries[1:] += 1
    widths = np.minimum(12, [int(e).bit_length() for e in entries])
    return widths, np.cumsum(widths) - widths


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of data, whose values have so many bits; starts with a clear code and ends with the end code."""
    clear = 1 << bits
    runs: list[list[int]] = []
    table: dict[int, int] = {}
    out: list[int] = []
    free = clear + 2
    prefix = -1
    get = table.get
    for value in data:
        if prefix < 0:
            prefix = value
            continue
        code = get(key := prefix << 8 | value)
        if code is not None:
            prefix = code
            continue
        out.append(prefix)
        table[key] = free
        free += 1
        prefix = value
        if free == 4096:
            out.append(prefix)
            runs.append(out)
            out, prefix, free = [], -1, clear + 2
            table.clear()
    if prefix >= 0:
        out.append(prefix)
    runs.append(out)
    each, starts = _layout(bits)
    codes, places, at = [np.asarray([clear])], [np.zeros(1, np.int64)], bits + 1
    for i, run in enumerate(runs):
        run.append(clear + 1 if i == len(runs) - 1 else clear)
        codes.append(np.asarray(run, np.int64))
        places.append(starts[: len(run)] + at)
        at += int(starts[len(run) - 1] + each[len(run) - 1])
    codes, places = np.concatenate(codes), np.concatenate(places)
    shifted, byte = codes << (places & 7), places >> 3
    n = (at + 7) // 8 + 3
    return sum(np.bincount(byte + i, shifted >> 8 * i & 255, n) for i in range(3)).astype(np.uint8)[: (at + 7) // 8].tobytes()


def lzw_decode(stream: bytes, bits: int) -> bytes:
    """Values of a code stream, up to its end code or its last whole code."""
    clear = 1 << bits
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    end = 8 * len(stream)
    each, starts = _layout(bits)
    each, starts = each[:4096], starts[:4096]

    def codes_at(places: np.ndarray, widths: np.ndarray) -> np.ndarray:
        byte = places >> 3
        return (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (places & 7) & ((1 << widths) - 1)

    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at = 0
    while True:
        # The widths of all codes up to the next clear code are known beforehand; a full table stays at 12 bits.
        size = int(np.searchsorted(starts + each, end - at, side="right"))
        if not size:
            return b"".join(out)
        codes = codes_at(at + starts[:size], each[:size])
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        known = codes[: stop[0]] if len(stop) else codes
        table = roots.copy()
        previous = b""
        add, emit = table.append, out.append
        for code in known.tolist():
            if previous:
                entry = table[code] if code < len(table) else previous + previous[:1]
                if len(table) < 4096:
                    add(previous + entry[:1])
            else:
                entry = table[code]
            emit(entry)
            previous = entry
        if len(stop):
            if codes[stop[0]] == clear + 1:
                return b"".join(out)
            at += int(starts[stop[0]] + each[stop[0]])
            continue
        at += int(starts[size - 1] + each[size - 1])
        # No clear code although the table is full: fixed-width codes go on with the same table.
        while at + 12 <= end:
            code = int(codes_at(np.asarray(at), np.asarray(12)))
            at += 12
            if code == clear:
                break
            if code == clear + 1:
                return b"".join(out)
            out.append(table[code])
        else:
            return b"".join(out)


# --- files ------------------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    """Data in sub-blocks of up to 255 bytes, with the empty one that ends them."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """payload (a positive multiple of width) as palette indices of one or more timed frames, under a grey palette."""
    height = min(rows, len(payload) // width)
    out = [struct.pack("<6sHHBBB", b"GIF89a", width, height, 0xF7, 0, 0), bytes(v for i in range(256) for v in (i, i, i))]
    for start in range(0, len(payload), width * rows):
        part = payload[start : start + width * rows]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        out.append(_blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """canvas: height x width x 4 (RGBA) as shown; indices: the samples of the frame's own rectangle."""

    canvas: np.ndarray
    indices: np.ndarray
    left: int
    top: int
    delay_ms: int


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray | None, int]:
    if not packed & 0x80:
        return None, at
    n = 2 << (packed & 7)
    return np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n


def _chain(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def read_frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF file, composed onto its canvas. Raises ValueError if it is no GIF file or broken off."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF file")
    try:
        width, height, packed, background = struct.unpack_from("<HHBB", data, 6)
        shared, at = _palette(data, 13, packed)
        canvas = np.zeros((height, width, 4), np.uint8)
        delay = disposal = 0
        transparent = None
        while (kind := data[at]) != 0x3B:
            if kind == 0x21:
                if data[at + 1] == 0xF9:
                    flags, delay, index = struct.unpack_from("<BHB", data, at + 3)
                    disposal, transparent = flags >> 2 & 7, index if flags & 1 else None
                _, at = _chain(data, at + 2)
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown block {kind}")
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _palette(data, at + 10, packed)
            palette = own if own is not None else shared
            stream, end = _chain(data, at + 1)
            decoded = lzw_decode(stream, data[at])
            if len(decoded) < w * h:
                raise ValueError("the code stream is too short")
            samples = np.frombuffer(decoded[: w * h], np.uint8).reshape(h, w)
            at = end
            if packed & 0x40:
                order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
                plain = np.empty_like(samples)
                plain[order] = samples
                samples = plain
            if palette is None:
                raise ValueError("no palette")
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            seen = samples[: area.shape[0], : area.shape[1]]
            colours = np.full((256, 4), (0, 0, 0, 255), np.uint8)
            colours[: len(palette), :3] = palette
            drawn = colours.view(np.uint32).ravel()[seen].view(np.uint8).reshape(*seen.shape, 4)
            if transparent is None:
                area[:] = drawn
            else:
                np.copyto(area, drawn, where=(seen != transparent)[..., None])
            yield Frame(canvas.copy(), samples, left, top, delay * 10)
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            delay = disposal = 0
            transparent = None
    except (IndexError, struct.error) as error:
        raise ValueError("the GIF file is broken off") from error


def histogram(frame: Frame, levels: int = LEVELS) -> np.ndarray:
    """Visible pixels by colour: levels ** 3 counts, red before green before blue."""
    red, green, blue, shown = (frame.canvas[..., i].astype(np.uint16) for i in range(4))
    level = [c * levels >> 8 for c in (red, green, blue)]
    bins = (level[0] * levels + level[1]) * levels + level[2]
    return np.bincount(bins[shown > 0], minlength=levels**3)


# --- columns ----------------------------------------------------------------------------------------------------


def padded(text: bytes, width: int = WIDTH) -> bytes:
    return text + b" " * (max(width, -(-len(text) // width) * width) - len(text))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, padded with spaces to a positive multiple of 192, as a GIF file.

    A null text counts as empty. Equal texts give equal files. Repeated rows stay; an empty table gives an empty table;
    other columns are not read, whatever their names.
    """

    def work(frames):
        for frame in slices(frames, BATCH):
            raw = [t.encode() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": list(map(len, raw)), "media": [write_gif(padded(r)) for r in raw]})

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(work, "doc_id long, n_bytes long, media binary")


def frames_of(media: DataFrame) -> DataFrame:
    """(doc_id, frame, at_ms, delay_ms, width, height, histogram) of each frame of the files in column media.

    Files that can't be read (null included) have no frames; other files with the same doc_id keep theirs.
    """

    def work(frames):
        for frame in slices(frames, BATCH):
            rows = []
            for doc_id, data in zip(frame["doc_id"], frame["media"]):
                at, own = 0, []
                try:
                    for i, f in enumerate(read_frames(data or b"")):
                        own.append((doc_id, i, at, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], histogram(f).tolist()))
                        at += f.delay_ms
                except ValueError:
                    continue
                rows += own
            yield pd.DataFrame(rows, columns=["doc_id", "frame", "at_ms", "delay_ms", "width", "height", "histogram"])

    schema = "doc_id long, frame int, at_ms long, delay_ms int, width int, height int, histogram array<long>"
    return media.select("doc_id", "media").mapInPandas(work, schema)


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from each stored file: payload digests and the summed colour histogram of its frames."""

    def work(frames):
        for frame in slices(frames, BATCH):
            rows = []
            for doc_id, n, data in zip(frame["doc_id"], frame["n_bytes"], frame["media"]):
                parts, shown, counts = [], 0, np.zeros(LEVELS**3, np.int64)
                for f in read_frames(data):
                    parts.append(f.indices.tobytes())
                    shown += f.delay_ms
                    counts += histogram(f)
                payload = b"".join(parts)
                feature = f"frames={len(parts)};ms={shown};colours=" + ",".join(f"{i}:{c}" for i, c in enumerate(counts) if c)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInPandas(work, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
