"""GIF media columns: encode byte payloads as 24 x 24 frames, decode any GIF into timed frames.

The decoder reads the container (logical screen, colour tables, graphic control and image blocks,
interlace), decodes the LZW code streams, applies palettes, transparency and disposal, and gives frames
with start times and colour histograms. ``encode_frames`` writes 8-bit samples losslessly, compressed by LZW
with the full table of 12-bit codes, in a palette of 8 x 8 x 4 colours from which ``samples_of`` tells the
samples again.

LZW decoding is done for many frames at once: between two clear codes the width of each code depends
only on its number, so that all codes of a run are cut out as one matrix; each code then stands for an
earlier range of the output (entry e is the string of code e plus the next byte), and ranges are resolved
by pointer doubling instead of a loop over codes.

A malformed file raises ``GifError`` with the reason; a malformed stream fails its own file alone.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SIDE = 24
FRAME = SIDE * SIDE
#: Colour of each sample: three bits of red, three of green, two of blue.
PALETTE = np.array([((i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85) for i in range(256)], dtype=np.uint8)
DELAY = 4  # hundredths of a second
MOST_PIXELS = 1 << 26  # of a screen or an image; a file that claims more is taken for malformed


class GifError(ValueError):
    pass


# ---------------------------------------------------------------- LZW


def lzw_codes(samples: bytes, least: int) -> list[list[int]]:
    """Runs of codes; a clear code comes before each run, as the table is full after it."""
    first = (1 << least) + 2
    runs, out, table, n = [], [], {}, first
    get, word = table.get, -1
    for s in samples:
        if word < 0:
            word = s
            continue
        key = word << 8 | s
        code = get(key)
        if code is not None:
            word = code
            continue
        out.append(word)
        word = s
        if n < 4096:
            table[key] = n
            n += 1
        else:
            runs.append(out)
            out, n = [], first
            table.clear()
    if word >= 0:
        out.append(word)
    return [*runs, out]


TABLE = 2048  # slots of a frame's table in ``lzw_together``
TOGETHER = 900  # samples of a frame at most, for that


def lzw_together(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (frames, n) of frames of 8-bit samples (frames, n), n up to TOGETHER, and their numbers: the same as ``lzw_codes``.

    All frames go on by one sample at a time; a frame's entries are in an open table of (code before, sample).
    """
    frames, n = samples.shape
    base = np.arange(frames, dtype=np.int64) * TABLE
    keys, codes = np.full(frames * TABLE, -1, dtype=np.int32), np.zeros(frames * TABLE, dtype=np.int32)
    out, count = np.zeros((frames, n), dtype=np.int64), np.zeros(frames, dtype=np.int64)
    columns = np.ascontiguousarray(samples.T).astype(np.int32)
    word = columns[0]
    for j in range(1, n):
        s = columns[j]
        key = word << 8 | s
        slot = base + ((key * 40503 >> 5) & (TABLE - 1))
        have = keys[slot]
        other = np.flatnonzero((have != key) & (have >= 0))
        while len(other):
            slot[other] = base[other] + (slot[other] + 1 & (TABLE - 1))
            have[other] = keys[slot[other]]
            other = other[(have[other] != key[other]) & (have[other] >= 0)]
        miss = np.flatnonzero(have < 0)
        at, k = slot[miss], count[miss]
        keys[at] = key[miss]
        codes[at] = 258 + k
        out[miss, k] = word[miss]
        count[miss] += 1
        word = codes[slot]
        word[miss] = s[miss]
    out[np.arange(frames), count] = word
    return out, count + 1


def lzw_encode(frames: list[bytes], least: int = 8) -> list[bytes]:
    """Code streams of frames; the bits of all of them are packed together."""
    clear, stop = 1 << least, (1 << least) + 1
    alike = least == 8 and len({len(f) for f in frames}) == 1 and 0 < len(frames[0]) <= TOGETHER
    if alike:
        matrix, count = lzw_together(np.frombuffer(b"".join(frames), dtype=np.uint8).reshape(len(frames), -1))
        matrix = np.concatenate([matrix, np.zeros((len(frames), 1), np.int64)], axis=1)
        matrix[np.arange(len(frames)), count] = stop
        codes = matrix[np.arange(matrix.shape[1]) <= count[:, None]]
        size, runs_of = count + 1, np.ones(len(frames), np.int64)
    else:
        every, lengths, numbers = [], [], []
        for samples in frames:
            runs = lzw_codes(samples, least)
            for k, run in enumerate(runs):
                every += run
                every.append(clear if k + 1 < len(runs) else stop)
                lengths.append(len(run) + 1)
            numbers.append(len(runs))
        codes, size, runs_of = np.array(every, np.int64), np.array(lengths), np.array(numbers)
    width_of = _code_places(int(size.max(initial=1)), least)[1]
    begin = np.cumsum(size) - size
    width = width_of[np.arange(len(codes)) - np.repeat(begin, size)]
    lead = np.cumsum(runs_of) - runs_of  # each frame's first run
    bits = np.add.reduceat(width, begin[lead]) + least + 1  # with the first clear code
    start = np.cumsum((bits + 7) // 8) - (bits + 7) // 8  # bytes
    ends = np.append(start[1:], start[-1] + (bits[-1] + 7) // 8)
    frame = np.repeat(np.arange(len(frames)), np.add.reduceat(size, lead))
    before = np.cumsum(width) - width
    at = start[frame] * 8 + least + 1 + before - before[begin[lead]][frame]
    value = np.concatenate([np.full(len(frames), clear, np.int64), codes])
    at = np.concatenate([start * 8, at])
    value <<= at & 7
    out = np.zeros(int(ends[-1]) + 3, dtype=np.int64)
    for k in range(3):  # no two codes share a bit
        out += np.bincount((at >> 3) + k, weights=(value >> (8 * k)) & 255, minlength=len(out)).astype(np.int64)[: len(out)]
    raw = out.astype(np.uint8).tobytes()
    return [raw[x:y] for x, y in zip(start.tolist(), ends.tolist(), strict=True)]


def _code_places(count: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset after the clear code, and width, of codes 0..count-1 of a run."""
    # code j is read when the table has 2**least + 2 + max(j - 1, 0) entries
    size = (1 << least) + 2 + np.maximum(np.arange(count) - 1, 0)
    width = np.minimum(np.maximum(np.ceil(np.log2(size + 1)).astype(np.int64), least + 1), 12)
    return np.cumsum(width) - width, width


def _expand(codes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of a run of codes of each of many frames, one after the other, their numbers, and which frames are sound.

    Row i of codes has ends[i] codes, without clear and end codes.
    """
    first = (1 << least) + 2
    number = np.arange(codes.shape[1])
    there = number < ends[:, None]
    entry = np.where(there & (codes >= first), codes - first, -1)
    sound = ~(entry >= number).any(1)
    ends = np.where(sound, ends, 0)
    there &= sound[:, None]
    entry[~there] = -1
    length = there.astype(np.int64)
    for j in np.flatnonzero((entry >= 0).any(0)).tolist():
        on = np.flatnonzero(entry[:, j] >= 0)
        length[on, j] = length[on, entry[on, j]] + 1
    base = np.cumsum(ends) - ends
    source_code = (entry + base[:, None])[there]
    literal, value, length = entry[there] < 0, codes[there], length[there]
    start = np.cumsum(length) - length
    total = int(length.sum())
    owner = np.repeat(np.arange(len(length)), length)
    root = np.arange(total)
    copied = ~literal[owner]
    root[copied] += (start[source_code] - start)[owner[copied]]
    live = np.flatnonzero(copied)
    while len(live):
        further = root[root[live]]
        moved = further != root[live]
        root[live] = further
        live = live[moved]
    out = np.zeros(total, dtype=np.uint8)
    out[start[literal]] = value[literal]
    per_frame = np.zeros(len(ends), dtype=np.int64)
    np.add.at(per_frame, np.repeat(np.arange(len(ends)), ends), length)
    return out[root], per_frame, sound


def lzw_decode(streams: np.ndarray, least: int, pixels: int) -> tuple[np.ndarray, np.ndarray]:
    """Decodes streams (frames, bytes), padded to one length, into samples (frames, pixels), and tells which are sound."""
    frames = len(streams)
    out = np.zeros((frames, pixels), dtype=np.uint8)
    sound = np.ones(frames, dtype=bool)
    padded = np.zeros((frames, streams.shape[1] + 4), dtype=np.uint32)
    padded[:, :-4] = streams
    three = padded[:, :-2] | (padded[:, 1:-1] << 8) | (padded[:, 2:] << 16)
    bits = streams.shape[1] * 8
    clear, stop = 1 << least, (1 << least) + 1
    limit = min(pixels + 2, max(1, bits // (least + 1)) + 1)
    place, width = _code_places(limit, least)
    mask = ((1 << width) - 1).astype(np.uint32)
    done = np.zeros(frames, dtype=np.int64)
    bit = np.zeros(frames, dtype=np.int64)
    live = np.arange(frames)
    while len(live):
        room = int((pixels - done[live]).max()) + 2
        n = min(limit, room)
        at = bit[live][:, None] + place[:n]
        over = at + width[:n] > bits
        at = np.minimum(at, max(bits - 1, 0))
        codes = ((three[live[:, None], at >> 3] >> (at & 7).astype(np.uint32)) & mask[:n]).astype(np.int64)
        codes[over] = stop
        special = (codes == clear) | (codes == stop)
        ends = np.where(special.any(1), special.argmax(1), n)
        got, count, fine = _expand(codes, ends, least)
        sound[live[~fine]] = False
        take = np.minimum(count, pixels - done[live])
        to = np.repeat(done[live], count) + np.arange(len(got)) - np.repeat(np.cumsum(count) - count, count)
        keep = to < pixels
        out[np.repeat(live, count)[keep], to[keep]] = got[keep]
        done[live] += take
        last = np.minimum(ends, n - 1)
        go = fine & (ends < n) & (done[live] < pixels) & (codes[np.arange(len(live)), last] == clear)
        bit[live] += place[last] + width[last]
        live = live[go]
    return out, sound & (done == pixels)


# ---------------------------------------------------------------- container


def encode_frames(payload: bytes) -> bytes:
    """A GIF of 24 x 24 frames; len(payload) is a positive multiple of 576."""
    return assemble(lzw_encode([payload[a : a + FRAME] for a in range(0, len(payload), FRAME)]))


_HEAD = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + PALETTE.tobytes() + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
_LEAD = b"\x21\xf9\x04\x04" + struct.pack("<H", DELAY) + b"\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"


def assemble(streams: list[bytes]) -> bytes:
    """The GIF file around the code streams of its frames."""
    parts = [_HEAD]
    for stream in streams:
        parts.append(_LEAD)
        for a in range(0, len(stream), 255):
            block = stream[a : a + 255]
            parts += (bytes((len(block),)), block)
        parts.append(b"\x00")
    return b"".join([*parts, b"\x3b"])


_RED, _GREEN, _BLUE = ((np.arange(256) // step << shift).astype(np.uint8) for step, shift in ((36, 5), (36, 2), (85, 0)))


def samples_of(canvas: np.ndarray) -> np.ndarray:
    """Samples of a shown frame in the colours of PALETTE."""
    return _RED[canvas[..., 0]] | _GREEN[canvas[..., 1]] | _BLUE[canvas[..., 2]]


def opaque(table: np.ndarray) -> np.ndarray:
    """256 RGBA colours of a colour table; those that it doesn't have are transparent."""
    out = np.zeros((256, 4), dtype=np.uint8)
    out[: len(table), :3] = table
    out[: len(table), 3] = 255
    return out


@dataclass
class Image:
    """One image block: where it goes, when, and its stream."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    interlaced: bool
    least: int
    stream: bytes
    delay: int = 0
    disposal: int = 0
    clear_index: int = -1  # the transparent index


def parse_gif(media: bytes) -> tuple[int, int, list[Image]]:
    """Screen width and height, and the image blocks in order."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("not a GIF")
    try:
        return _parsed(media)
    except (struct.error, IndexError) as e:
        raise GifError("file ends early") from e
    except ValueError as e:
        raise GifError(str(e) if isinstance(e, GifError) else "colour table ends early") from e


def _parsed(media: bytes) -> tuple[int, int, list[Image]]:
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    if width * height > MOST_PIXELS:
        raise GifError("screen too large")
    at, images = 13, []
    common = opaque(np.zeros((0, 3), np.uint8))
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = opaque(np.frombuffer(media, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3))
        at += 3 * n
    control = (0, 0, -1)
    while True:
        kind = media[at]
        if kind == 0x3B:
            return width, height, images
        if kind == 0x21:
            if media[at + 1] == 0xF9:
                f, delay, index = struct.unpack_from("<BHB", media, at + 3)
                control = (delay, (f >> 2) & 7, index if f & 1 else -1)
            at += 2
        elif kind == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            if w * h > MOST_PIXELS:
                raise GifError("image too large")
            palette = common
            if f & 0x80:
                n = 2 << (f & 7)
                palette = opaque(np.frombuffer(media, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3))
                at += 3 * n
            least = media[at]
            at += 1
            if not 2 <= least <= 8:
                raise GifError(f"code size {least}")
        else:
            raise GifError(f"unknown block {kind}")
        parts = []
        while size := media[at]:
            parts.append(media[at + 1 : at + 1 + size])
            at += 1 + size
        at += 1
        if kind == 0x2C:
            images.append(Image(left, top, w, h, palette, bool(f & 0x40), least, b"".join(parts), *control))
            control = (0, 0, -1)


def image_samples(images: list[Image]) -> list[np.ndarray | None]:
    """Colour indexes of each image (height, width), None if its stream is malformed; images of one shape are decoded together."""
    alike: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        alike.setdefault((x.least, x.width, x.height), []).append(i)
    out: list = [None] * len(images)
    for (least, w, h), members in alike.items():
        members.sort(key=lambda i: len(images[i].stream))
        step = max(1, min(1024, (1 << 20) // max(1, w * h)))
        for a in range(0, len(members), step):
            some = members[a : a + step]
            wide = max(1, len(images[some[-1]].stream))
            streams = np.frombuffer(b"".join(images[i].stream.ljust(wide, b"\0") for i in some), dtype=np.uint8).reshape(len(some), wide)
            for i, pixels, sound in zip(some, *lzw_decode(streams, least, w * h), strict=True):
                if sound:
                    out[i] = _deinterlaced(pixels.reshape(h, w)) if images[i].interlaced else pixels.reshape(h, w)
    return out


def _deinterlaced(rows: np.ndarray) -> np.ndarray:
    h = len(rows)
    order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def render(width: int, height: int, images: list[Image], samples: list[np.ndarray]):
    """Yields (start in hundredths, delay, RGBA canvas) for each image, by palette, transparency and disposal."""
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    now = 0
    for x, index in zip(images, samples, strict=True):
        if index is None:
            raise GifError("malformed code stream")
        before = canvas.copy() if x.disposal == 3 else None
        area = canvas[x.top : x.top + x.height, x.left : x.left + x.width]
        index = index[: area.shape[0], : area.shape[1]]
        if x.clear_index < 0:
            area[:] = x.palette[index]
        else:
            drawn = index != x.clear_index
            area[drawn] = x.palette[index[drawn]]
        yield now, x.delay, canvas.copy()
        now += x.delay
        if x.disposal == 2:
            area[:] = 0
        elif x.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels over 4 x 4 x 4 colours."""
    c = (canvas[..., 0] >> 6 << 4) | (canvas[..., 1] >> 6 << 2) | canvas[..., 2] >> 6
    shown = canvas[..., 3] > 0
    return np.bincount(c.ravel() if shown.all() else c[shown], minlength=64)
