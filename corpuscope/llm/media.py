"""Media columns (operator 9): payloads as PNG in a binary column, read back with every checksum tested, and
low-frequency cosine-transform hashes.

Writing: the samples become an 8-bit grey image, one filter is chosen for the image by the entropy of the filtered
bytes, and the zlib stream is cut into IDAT chunks with their CRC-32. Reading: signature, the CRC of each chunk, the
header, the zlib stream's own Adler-32 and the size are tested, then numpy undoes the filters: runs of rows for the
filters that only look left or up, a wavefront over the anti-diagonals for the other two.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import modest_batches, utf8_column

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
NONE, SUB, UP, AVERAGE, PAETH = range(5)  # fixed values of the format
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values of the format: samples of a pixel by colour type
CHUNK = 1 << 16
TILE = 576  # a payload is a positive multiple of this: 24 x 24 samples
WIDTH = 24


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // TILE)) * TILE - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _entropy(samples: np.ndarray) -> float:
    n = np.bincount(samples.ravel(), minlength=256)
    n = n[n > 0]
    return float(-(n * np.log2(n / samples.size)).sum())


def png_encode(samples: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey image (rows, columns), losslessly."""
    rows, columns = samples.shape
    left, above = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    above[1:] -= samples[:-1]
    filtered = {NONE: samples, SUB: left, UP: above}
    kind = min(filtered, key=lambda k: _entropy(filtered[k]))
    lines = np.empty((rows, columns + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = filtered[kind]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", packed[a : a + CHUNK]) for a in range(0, len(packed), CHUNK)), _chunk(b"IEND", b"")])


def _chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("a chunk is cut off")
        (size,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        if image[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"the checksum of chunk {kind!r} is wrong")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("no end chunk")


def png_decode(image: bytes) -> np.ndarray:
    """The samples (rows, columns, channels) of an 8-bit PNG without interlace or palette."""
    head, packed = None, []
    for kind, body in _chunks(image):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0):
        raise ValueError("an unsupported PNG header")
    columns, rows, channels = head[0], head[1], CHANNELS[head[3]]
    inflate = zlib.decompressobj()
    raw = b"".join([*map(inflate.decompress, packed), inflate.flush()])
    if not inflate.eof or len(raw) != rows * (columns * channels + 1):
        raise ValueError("the image data are cut off or too long")
    lines = np.frombuffer(raw, np.uint8).reshape(rows, -1)
    return unfilter(lines[:, 0], lines[:, 1:].reshape(rows, columns, channels))


def unfilter(kinds: np.ndarray, filtered: np.ndarray) -> np.ndarray:
    """Undoes each row's filter; sums wrap at 256."""
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError("an unknown filter")
    if np.isin(kinds, (AVERAGE, PAETH)).any():
        return _wavefront(kinds, filtered)
    out = filtered.copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(edges, edges[1:]):
        if a == b or kinds[a] == NONE:
            continue
        if kinds[a] == SUB:
            out[a:b] = np.cumsum(filtered[a:b], axis=1, dtype=np.uint8)
        else:
            out[a:b] = np.cumsum(filtered[a:b], axis=0, dtype=np.uint8)
            if a:
                out[a:b] += out[a - 1]
    return out


def _wavefront(kinds: np.ndarray, filtered: np.ndarray) -> np.ndarray:
    rows, columns, channels = filtered.shape
    done = np.zeros((rows + 1, columns + 1, channels), np.int16)  # a border of zeros above and left
    for d in range(rows + columns - 1):
        i = np.arange(max(0, d - columns + 1), min(rows, d + 1))
        j = d - i
        left, above, corner = done[i + 1, j], done[i, j + 1], done[i, j]
        guess = left + above - corner
        dl, da, dc = abs(guess - left), abs(guess - above), abs(guess - corner)
        nearest = np.where((dl <= da) & (dl <= dc), left, np.where(da <= dc, above, corner))
        kind = kinds[i][:, None]
        by = np.select([kind == SUB, kind == UP, kind == AVERAGE, kind == PAETH], [left, above, (left + above) // 2, nearest], 0)
        done[i + 1, j + 1] = (filtered[i, j] + by) & 0xFF
    return done[1:, 1:].astype(np.uint8)


@lru_cache(maxsize=256)
def _cosines(n: int) -> np.ndarray:
    """The eight lowest cosine waves over n samples."""
    k, x = np.arange(8)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt((2 - (k == 0)) / n)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: whether each of the 8 x 8 lowest coefficients of a grey image is above the median of those but the
    mean. Coefficients count to six decimals."""
    rows, columns = samples.shape
    waves = (_cosines if rows <= 4096 else _cosines.__wrapped__)(rows)
    low = np.round(waves @ samples.astype(np.float64) @ _cosines(columns).T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def media_columns(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """Stores each whole text's payload (UTF-8, then bytes 255 up to a positive multiple of 576) as a PNG of width
    24, reads that back, and computes the hash from the samples read.

    Returns the kept columns, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the last 32 bytes) as read
    back, media_bytes, media_sha256 and feature; with full=True also media, the PNG itself. A null or empty text is
    one tile of 255. Equal texts give equal values; repeated rows stay; an empty table gives an empty result; a text
    has memory to its own size. A read-back that differs raises.
    """
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [f for f in src.schema.fields if f.name != "__text"]
    own = ["n_bytes bigint", "payload_bytes bigint", "payload_sha256 string", "tail_crc32 bigint", "media_bytes bigint", "media_sha256 string", "feature string"] + ["media binary"] * full
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in utf8_column(batch.column("__text")):
                payload = padded(t)
                media = png_encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
                samples = png_decode(media)[:, :, 0]
                back = samples.tobytes()
                if back != payload:
                    raise ValueError("a stored payload reads back otherwise")
                rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples), *[media] * full))
            out = dict(zip([x.split()[0] for x in own], zip(*rows))) if rows else {x.split()[0]: [] for x in own}
            kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            columns = {f.name: batch.column(f.name) for f in fields}
            yield pa.RecordBatch.from_pydict(columns | {x.split()[0]: pa.array(list(out[x.split()[0]]), kinds[x.split()[1]]) for x in own})

    return modest_batches(src).mapInArrow(run, schema)
