"""Media columns: AVI with motion-JPEG, its frames, and shots."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a side of a frame; a sample is a flat block of 8 x 8 pixels, the unit that JPEG codes.
SIDE, BLOCK = 24, 8
SAMPLES = SIDE * SIDE
FPS = 25
#: Frames that are coded or decoded together.
FRAMES = 512
#: Brightness bins of a histogram; frames of the sliding window, deviations and least difference that make a cut.
BINS, NEAR, DEVIATIONS, LEAST = 32, 12, 2.0, 0.15


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head() -> bytes:
    """The markers before a frame's scan: all quantisers 8, so that a block's DC coefficient is its brightness less 128.

    DC categories 0 to 8 have codes of 4 bits, and the end of a block, the only AC symbol, one of 1 bit.
    """
    size = SIDE * BLOCK
    dc = bytes([0, 0, 0, 9, *[0] * 12]) + bytes(range(9))
    ac = bytes([1, *[0] * 15]) + bytes([0])
    return b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([8] * 64)) + _segment(0xC0, struct.pack(">BHHBBBB", 8, size, size, 1, 1, 0x11, 0)) + _segment(0xC4, bytes([0x00]) + dc) + _segment(0xC4, bytes([0x10]) + ac) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_frames(samples) -> list[bytes]:
    """(n, SAMPLES) bytes to n baseline JPEG files."""
    import numpy as np

    n = len(samples)
    d = np.diff(samples.astype(np.int32) - 128, axis=1, prepend=np.int32(0)).ravel()
    cat = np.frexp(np.abs(d).astype(np.float32))[1]  # bits of the magnitude
    val = (cat << (cat + 1)) | (np.where(d < 0, d + (1 << cat) - 1, d) << 1)  # category, bits, end of block
    length = (cat + 5).reshape(n, SAMPLES)
    fill = -length.sum(1) % 8
    val = np.concatenate([val.reshape(n, SAMPLES), ((1 << fill) - 1)[:, None]], 1).ravel()
    length = np.concatenate([length, fill[:, None]], 1)
    flat = length.ravel()
    bits = ((val[:, None] >> (flat[:, None] - 1 - np.arange(13)).clip(0)) & 1).astype(np.uint8)
    data = np.packbits(bits[np.arange(13) < flat[:, None]])
    ends = np.cumsum(length.sum(1) // 8)
    full = np.flatnonzero(data == 255)
    stuffed = np.insert(data, full + 1, 0).tobytes()
    ends = ends + np.searchsorted(full, ends)
    head = frame_head()
    return [head + stuffed[a:b] + b"\xff\xd9" for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def write_avi(frames: list[bytes], side: int = SIDE * BLOCK, fps: int = FPS) -> bytes:
    """A RIFF AVI file of motion-JPEG frames with an index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    many = lambda kind, body: chunk(b"LIST", kind + body)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    body, index, at = [], [], 4
    for f in frames:
        body.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + many(b"hdrl", chunk(b"avih", avih) + many(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf))) + many(b"movi", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """(microseconds a frame, the frames that the index lists). ValueError for what is no such file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    at, movi, index, pace = 12, None, None, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            pace = struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        start = movi + offset
        if name[2:] in (b"dc", b"db"):
            if data[start : start + 4] != name or struct.unpack_from("<I", data, start + 4)[0] != size:
                raise ValueError("the index and the frames differ")
            frames.append(data[start + 8 : start + 8 + size])
    return pace, frames


def _huffman(body: bytes):
    """Of a DHT table: by the next 16 bits, the code's length and its symbol."""
    import numpy as np

    length, symbol = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    code, k = 0, 16
    for bits in range(1, 17):
        for _ in range(body[bits - 1]):
            a, b = code << (16 - bits), (code + 1) << (16 - bits)
            length[a:b], symbol[a:b] = bits, body[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def _head(frame: bytes) -> dict:
    """Sizes and tables of a baseline frame of one component, and where its scan starts."""
    out: dict = {"dht": {}}
    at = 2
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            out["quant"] = body[1:65]
        elif marker == 0xC0:
            _, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only frames of one component are read")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["dht"][body[0]] = _huffman(body[1:n])
                body = body[n:]
        elif marker == 0xDA:
            return out | {"scan": at + 2 + size, "dc": out["dht"][body[2] >> 4], "ac": out["dht"][0x10 | body[2] & 15]}
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames are read")
        at += 2 + size


def decode_frames(frames: list[bytes]):
    """Dequantised coefficients of frames that share their markers: DC (n, blocks), AC (n, blocks, 64; in zigzag order) or None.

    All frames advance together, one symbol a step, so the steps are numpy
    operations over as many elements as there are frames.
    """
    import numpy as np

    head = _head(frames[0])
    lead = frames[0][: head["scan"]]
    if any(f[: head["scan"]] != lead for f in frames):
        raise ValueError("frames with different markers in one call")
    scans = [f[head["scan"] : -2].replace(b"\xff\0", b"\xff") for f in frames]
    size = np.array([len(s) for s in scans])
    start = np.concatenate([[0], np.cumsum(size[:-1])])
    raw = np.frombuffer(b"".join(scans) + bytes(8), np.uint8).astype(np.uint32)
    word = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    p = (start * 8).astype(np.int64)
    n, blocks = len(frames), -(-head["height"] // 8) * -(-head["width"] // 8)
    dc, ac = np.zeros((n, blocks), np.int32), None
    (dc_len, dc_sym), (ac_len, ac_sym) = head["dc"], head["ac"]
    past = np.zeros(n, np.int32)

    def peek(at, bits):
        return (word[at >> 3] >> (32 - bits - (at & 7)).astype(np.uint32)) & np.uint32((1 << bits) - 1)

    def value(at, size):
        v = (peek(at, 16) >> (16 - size).astype(np.uint32)).astype(np.int32)
        return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)

    for b in range(blocks):
        x = peek(p, 16)
        p += dc_len[x]
        size = dc_sym[x]
        past += value(p, size)
        p += size
        dc[:, b] = past
        todo, k = np.arange(n), np.ones(n, np.int64)
        while len(todo):
            x = peek(p[todo], 16)
            p[todo] += ac_len[x]
            sym = ac_sym[x]
            if not sym.any():
                break
            go = sym != 0
            todo, sym = todo[go], sym[go]
            k[todo] += sym >> 4
            size = sym & 15
            put = size > 0
            if put.any():
                if ac is None:
                    ac = np.zeros((n, blocks, 64), np.int32)
                ac[todo[put], b, np.minimum(k[todo[put]], 63)] = value(p[todo[put]], size[put])
            p[todo] += size
            k[todo] += 1
            todo = todo[k[todo] < 64]
    if (p > (start + np.array([len(s) for s in scans])) * 8).any():
        raise ValueError("a scan is too short")
    quant = np.frombuffer(head["quant"], np.uint8).astype(np.int32)
    return head, dc * quant[0], None if ac is None else ac * quant


def pixels(frames: list[bytes]):
    """(n, height, width) bytes by the inverse cosine transform."""
    import numpy as np

    head, dc, ac = decode_frames(frames)
    n, blocks = dc.shape
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    coef = np.zeros((n, blocks, 64))
    if ac is not None:
        coef[:, :, order] = ac
    coef[:, :, 0] = dc
    t = np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    img = np.einsum("ux,nbuv,vy->nbxy", t, coef.reshape(n, blocks, 8, 8), t) + 128
    h, w = -(-head["height"] // 8), -(-head["width"] // 8)
    out = img.reshape(n, h, w, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, h * 8, w * 8)
    return np.rint(out).clip(0, 255).astype(np.uint8)[:, : head["height"], : head["width"]]


def samples(frames: list[bytes]):
    """(n, blocks): each block's mean brightness, a frame at an eighth of its size; exact for flat blocks."""
    import numpy as np

    _, dc, _ = decode_frames(frames)
    return ((dc + 1024) >> 3).clip(0, 255).astype(np.uint8)


def shots(thumbs) -> list[int]:
    """First frames of shots: where a histogram's difference from the frame before leaves what is usual nearby.

    A cut needs half the summed difference of two normalised histograms to be
    LEAST or more, and DEVIATIONS standard deviations over the mean of up to NEAR
    differences before it.
    """
    import numpy as np

    n, per = thumbs.shape
    hist = np.bincount((np.arange(n)[:, None] * BINS + (thumbs >> 3)).ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * per)
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    i = np.arange(len(diff))
    lo = np.maximum(0, i - NEAR)
    m = np.maximum(1, i - lo)
    mean = (s1[i] - s1[lo]) / m
    dev = np.sqrt(np.maximum(0, (s2[i] - s2[lo]) / m - mean * mean))
    return [0, *(np.flatnonzero((diff >= LEAST) & (diff > mean + DEVIATIONS * dev)) + 1).tolist()] if n else []


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8, filled with bytes 255 to a positive multiple of SAMPLES, and its length before that."""
    data = (text or "").encode("utf-8", "replace")
    return data + b"\xff" * (-len(data) % SAMPLES or (0 if data else SAMPLES)), len(data)


def _in_parts(frames, f):
    import numpy as np

    return np.concatenate([f(frames[i : i + FRAMES]) for i in range(0, len(frames), FRAMES)])


def text_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, media): every whole text as an AVI file, a sample a byte."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i, size in _groups(b.column(1)):
                part = b.slice(i, size)
                packed = [payload(t) for t in part.column(1).to_pylist()]
                all_ = np.frombuffer(b"".join(p for p, _ in packed), np.uint8).reshape(-1, SAMPLES)
                frames = [f for k in range(0, len(all_), FRAMES) for f in encode_frames(all_[k : k + FRAMES])]
                files, at = [], 0
                for p, _ in packed:
                    files.append(write_avi(frames[at : at + len(p) // SAMPLES]))
                    at += len(p) // SAMPLES
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in packed], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _groups(texts, limit: int = 1 << 20):
    """(start, rows) of runs of texts of about `limit` bytes."""
    import pyarrow.compute as pc

    start, total = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        total += n
        if total > limit:
            yield start, k + 1 - start
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts) - start


def _described(batches):
    """Batches of (doc_id, n_bytes, media) to the contract's columns, from what is read back."""
    import hashlib
    import zlib

    import numpy as np
    import pyarrow as pa

    for b in batches:
        read = [read_avi(m)[1] for m in b.column(2).to_pylist()]
        got = _in_parts([f for fs in read for f in fs], samples) if len(b) else np.empty((0, SAMPLES), np.uint8)
        cols, at = [[] for _ in range(6)], 0
        for fs, media in zip(read, b.column(2).to_pylist()):
            thumbs = got[at : at + len(fs)]
            at += len(fs)
            data = thumbs.tobytes()
            first = shots(thumbs)
            feature = f"frames={len(fs)};shots={len(first)};cuts={','.join(map(str, first))};mean={int(thumbs.sum(dtype=np.int64)) * 1000 // thumbs.size}"
            for col, v in zip(cols, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c) for c in cols]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def describe_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to sizes and digests of the payload and the stored form, and the feature."""
    return media.mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clips(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """media(id, media) to a row a shot: id, clip, first_frame, frames, start_s, end_s. What is no AVI of grey baseline frames has none."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    pace, frames = read_avi(data or b"")
                    first = shots(_in_parts(frames, samples)) if frames else []
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                for k, (a, e) in enumerate(zip(first, [*first[1:], len(frames)])):
                    rows.append((key, k, a, e - a, a * pace / 1e6, e * pace / 1e6))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [id_column, "clip", "first_frame", "frames", "start_s", "end_s"])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(id_column, "media").mapInArrow(run, f"{id_column} {kind}, clip int, first_frame int, frames int, start_s double, end_s double")
