import hashlib
import random
import struct
import zlib

import numpy as np

from pitchflow.llm import gif, media

from .helpers import empty_documents, odd_documents, odd_texts


def greedy(samples: bytes, least: int) -> bytes:
    """A plain LZW encoder, with clear codes when the table is full."""
    clear, stop = 1 << least, (1 << least) + 1
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    table, width = {bytes([i]): i for i in range(clear)}, least + 1
    put(clear, width)
    word = b""
    for s in samples:
        nxt = word + bytes([s])
        if nxt in table:
            word = nxt
            continue
        put(table[word], width)
        size = len(table) + 2
        if size < 4096:
            table[nxt] = size
            if size == 1 << width:
                width += 1
        else:
            put(clear, width)
            table, width = {bytes([i]): i for i in range(clear)}, least + 1
        word = bytes([s])
    if word:
        put(table[word], width)
        if len(table) + 2 == 1 << width and width < 12:
            width += 1
    put(stop, width)
    if n:
        out.append(bits & 255)
    return bytes(out)


def test_decodes_compressed_streams():
    rng = random.Random(1)
    for least, kinds, n in ((2, 4, 700), (4, 9, 5000), (8, 256, 9000), (8, 3, 60_000), (8, 256, 1)):
        samples = bytes(rng.randrange(kinds) if rng.random() < 0.7 else 0 for _ in range(n))
        stream = np.frombuffer(greedy(samples, least), dtype=np.uint8)[None]
        got, sound = gif.lzw_decode(stream, least, n)
        assert got.tobytes() == samples and sound.all()
        assert gif.lzw_encode([samples, samples[: n // 2 or 1]], least)[0] == greedy(samples, least)


def test_frames_encoded_together():
    rng = random.Random(4)
    frames = [bytes(rng.choice(rng.choice([b"ab", b"the and ", bytes(range(256))])) for _ in range(576)) for _ in range(40)] + [bytes(576), bytes(range(192)) * 3]
    assert gif.lzw_encode(frames) == [greedy(f, 8) for f in frames]


def test_streams_of_one_batch_may_differ():
    rng = random.Random(2)
    samples = [bytes(rng.randrange(5) for _ in range(600)) for _ in range(6)]
    streams = [greedy(s, 8) for s in samples]
    wide = max(map(len, streams))
    got = gif.lzw_decode(np.stack([np.frombuffer(s.ljust(wide, b"\0"), dtype=np.uint8) for s in streams]), 8, 600)[0]
    assert [x.tobytes() for x in got] == samples


def picture(frames: list[tuple[bytes, int, int, int]], w: int, h: int, interlaced: bool = False) -> bytes:
    """frames: samples, delay, disposal, transparent index (-1: none)."""
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 0, 255, 0, 0, 0])
    for samples, delay, disposal, clear in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear >= 0), delay, max(clear, 0)) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0x40 if interlaced else 0) + b"\x02"
        s = greedy(samples, 2)
        out += bytes([len(s)]) + s + b"\0"
    return out + b"\x3b"


def test_palette_transparency_disposal_and_times(spark):
    red, blue, mix = bytes([1] * 4), bytes([2] * 4), bytes([2, 0, 0, 2])
    data = picture([(red, 10, 1, -1), (mix, 20, 3, 0), (mix, 30, 2, 0), (mix, 5, 0, 0)], 2, 2)
    w, h, images = gif.parse_gif(data)
    shown = [(t, d, c.copy()) for t, d, c in gif.render(w, h, images, gif.image_samples(images))]
    assert [(t, d) for t, d, _ in shown] == [(0, 10), (10, 20), (30, 30), (60, 5)]
    colours = [["".join("-RB"[(p[3] > 0) * (1 + (p[2] > 0))] for p in row) for row in c] for _, _, c in shown]
    assert colours == [["RR", "RR"], ["BR", "RB"], ["BR", "RB"], ["B-", "-B"]]
    df = media.frames(spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, media binary"))
    rows = df.orderBy("frame").collect()
    assert [(r.id, r.start_s) for r in rows] == [(1, 0.0), (1, 0.1), (1, 0.3), (1, 0.6)] and sum(rows[0].histogram) == 4
    rows16 = bytes(range(4)) * 4
    order = [0, 8, 4, 12, 2, 6, 10, 14, 1, 3, 5, 7, 9, 11, 13, 15]
    striped = picture([(b"".join(bytes([y % 4]) for y in order), 0, 0, -1)], 1, 16, interlaced=True)
    assert gif.image_samples(gif.parse_gif(striped)[2])[0].tobytes() == rows16
    assert blue


def test_round_trip_of_odd_texts(spark):
    docs = odd_documents(spark)
    out = {r.h: r.d for r in media.with_gif(docs).select("h", media.digest("media").alias("d")).collect()}
    for i, t in enumerate(odd_texts()):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert out[5].asDict() == out[6].asDict()
    assert media.with_gif(empty_documents(spark)).select(media.digest("media")).count() == 0


def test_malformed_files_give_a_reason(spark):
    good = gif.encode_frames(bytes(range(256)) * 9)
    bad = [b"GIF89a", b"", b"PNG...", good[:400], good[:900], good[:900] + b"\x3b", bytearray(good)]
    bad[-1][820:840] = b"\xff" * 20
    df = spark.createDataFrame([(i, bytearray(b), "w") for i, b in enumerate([*bad, good])] + [(99, None, "w")], "id int, media binary, width string")
    out = {r.id: r.d for r in df.select("id", media.digest("media").alias("d")).collect()}
    assert all(out[i].error and out[i].payload_sha256 is None for i in range(len(bad))) and out[99] is None
    assert out[len(bad)].error is None and out[len(bad)].payload_sha256 == hashlib.sha256(bytes(range(256)) * 9).hexdigest()
    shown = media.frames(df)
    assert shown.columns.count("width") == 1 and {(r.id, r.width) for r in shown.collect()} == {(len(bad), 24)}


def test_feature_is_the_colour_histogram_of_shown_frames(spark):
    text = "Some text, é. " * 100
    row = media.with_gif(spark.createDataFrame([(text,)], "text string")).select(media.digest("media").alias("d")).first().d
    payload = text.encode() + b"\xff" * (-len(text.encode()) % 576)
    want = [0] * 64
    for b in payload:
        r, g, bl = (b >> 5) * 36, (b >> 2 & 7) * 36, (b & 3) * 85
        want[(r >> 6) * 16 + (g >> 6) * 4 + (bl >> 6)] += 1
    n = len(payload) // 576
    assert row.feature == f"{n}x24x24@{n * 0.04:.2f}:" + ",".join(map(str, want)) and row.histogram == want
    assert row.media_bytes < len(payload) + 900  # compressed
