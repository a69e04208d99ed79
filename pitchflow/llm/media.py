"""GIF media columns of a DataFrame.

``with_gif`` stores text payloads as GIFs, ``frames`` explodes a GIF column into timed frames with colour
histograms (one row each), ``digest`` reads stored GIFs back through palettes, transparency and disposal and
sums their frames up. A text's payload is its UTF-8 bytes, padded with bytes 255 to a positive multiple of 576.

Cases: a null text counts as empty, texts of any length are stored whole, equal texts give equal files; a null
file gives nulls and no frames; of a malformed file ``digest`` gives nulls and the reason in ``error``, and
``frames`` no row; columns of df with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gif
from .common import steps, text_arrays

DIGEST = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string,n_frames:int,duration_s:double,histogram:array<bigint>,error:string>"
DIGEST_ARROW = pa.struct([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("n_frames", pa.int32()), ("duration_s", pa.float64()), ("histogram", pa.list_(pa.int64())), ("error", pa.string()),
])
FRAMES = "array<struct<frame:int,start_s:double,delay_s:double,width:int,height:int,histogram:array<int>,rgba:binary>>"


def _media(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """GIFs of all texts; the code streams of one step are packed together."""
    out = []
    raw = data.tobytes()
    for a, b in steps(off):
        payloads = [raw[off[i] : off[i + 1]] for i in range(a, b)]
        payloads = [p + b"\xff" * (-len(p) % gif.FRAME if p else gif.FRAME) for p in payloads]
        count = [len(p) // gif.FRAME for p in payloads]
        streams = gif.lzw_encode([p[k : k + gif.FRAME] for p in payloads for k in range(0, len(p), gif.FRAME)])
        to = np.cumsum([0, *count]).tolist()
        out += [gif.assemble(streams[x:y]) for x, y in zip(to[:-1], to[1:], strict=True)]
    return out


def to_gif(text: pa.Array) -> pa.Array:
    return pa.array(_media(*text_arrays(text)), pa.binary())


def _digest(m: bytes, shown: list) -> dict:
    canvas = np.stack([c for _, _, c in shown])
    payload = gif.samples_of(canvas).tobytes()
    colours = gif.histogram(canvas)
    duration = sum(d for _, d, _ in shown) / 100
    h, w = canvas.shape[1:3]
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": f"{len(shown)}x{w}x{h}@{duration:.2f}:" + ",".join(map(str, colours)),
        "n_frames": len(shown), "duration_s": duration, "histogram": colours, "error": None,
    }


def read_back(media: pa.Array) -> pa.Array:
    """Digests of stored GIFs of payload frames, from the frames as they are shown; null gives null."""
    rows: list = [None] * len(media)
    held: list[tuple[int, bytes, int, int, list]] = []
    size = 0

    def flush() -> None:
        samples, at = gif.image_samples([x for *_, images in held for x in images]), 0
        for i, m, w, h, images in held:
            mine = samples[at : at + len(images)]
            at += len(images)
            try:
                shown = list(gif.render(w, h, images, mine))
                if not shown:
                    raise gif.GifError("no image")
                rows[i] = _digest(m, shown)
            except gif.GifError as e:
                rows[i] = {"error": str(e)}
        held.clear()

    for i, m in enumerate(media):
        if not m.is_valid:
            continue
        m = m.as_py()
        try:
            held.append((i, m, *gif.parse_gif(m)))
        except gif.GifError as e:
            rows[i] = {"error": str(e)}
        size += len(m)
        if size >= 1 << 19:
            flush()
            size = 0
    flush()
    return pa.array(rows, DIGEST_ARROW)


def timed_frames(media: pa.Array) -> pa.Array:
    out = []
    for m in media:
        if not m.is_valid:
            out.append(None)
            continue
        try:
            w, h, images = gif.parse_gif(m.as_py())
            shown = list(gif.render(w, h, images, gif.image_samples(images)))
        except gif.GifError:
            out.append(None)
            continue
        out.append([{"frame": i, "start_s": t / 100, "delay_s": d / 100, "width": w, "height": h, "histogram": gif.histogram(c).tolist(), "rgba": c.tobytes()} for i, (t, d, c) in enumerate(shown)])
    return pa.array(out, pa.list_(pa.struct([("frame", pa.int32()), ("start_s", pa.float64()), ("delay_s", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int32())), ("rgba", pa.binary())])))


def with_gif(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds a column with each text's payload as a GIF."""
    return df.withColumn(media, F.arrow_udf(to_gif, "binary")(F.col(text)))


def frames(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each frame of each GIF: frame, start_s, delay_s, width, height, histogram, rgba.

    Columns of df with one of these names are replaced.
    """
    new = ("frame", "start_s", "delay_s", "width", "height", "histogram", "rgba")
    rest = [c for c in df.columns if c != media and c not in new]
    return df.select(*rest, F.explode(F.arrow_udf(timed_frames, FRAMES)(F.col(media))).alias("_pf_frame")).select(*rest, *(F.col(f"_pf_frame.{c}").alias(c) for c in new))


def digest(media: Column | str) -> Column:
    """Struct of digests and features of what a stored GIF holds."""
    return F.arrow_udf(read_back, DIGEST)(F.col(media) if isinstance(media, str) else media)
