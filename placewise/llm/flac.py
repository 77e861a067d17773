"""Media columns as FLAC: 8-bit mono streams, written and read for many documents at once.

The encoder cuts a payload into frames of 576 samples (a sample is a byte less 128), predicts each
by the best of five fixed predictors and one fitted linear predictor, and writes Rice residuals in
four partitions. A stream has STREAMINFO with the MD5 of its samples and a SEEKTABLE with a point
for each frame. The decoder works on all frames of a batch in step: it reads frame headers, warm-up
samples, predictor coefficients and Rice codes, restores the samples, and checks CRC-8, CRC-16 and
MD5. Streams without a full seek table are read frame after frame.

Edge cases: null or empty texts are one frame of padding; repeated rows give equal streams; a
stream that fails a checksum raises ``ValueError``; other columns are ignored; very long texts are
taken in slices of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import batch_of, text_slices

BLOCK = 576
RATE = 8000
#: Order, precision and shift limit of the fitted predictor.
ORDER, PRECISION = 8, 12
#: log2 of the Rice partitions of a frame.
PARTITIONS = 2
#: Frames that are encoded or decoded together.
TOGETHER = 1500
#: Coefficients of the format's fixed predictors (fixed values).
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _table(poly: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << width) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, in step."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.zeros(len(at), np.uint32)
    counts = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    for k, n in enumerate(counts.tolist()):  # the n longest have a byte k
        c = crc[:n]
        crc[:n] = (c << 8 & 0xFFFF) ^ CRC16[(c >> 8) ^ data[at[:n] + k]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded(n: int) -> bytes:
    """A number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


def _uncoded(data: bytes) -> tuple[int, int]:
    """The number at the front and its length."""
    if data[0] < 0x80:
        return data[0], 1
    n = 8 - (data[0] ^ 0xFF).bit_length()
    if n == 1 or n > 7 or len(data) < n or any(b & 0xC0 != 0x80 for b in data[1:n]):
        raise ValueError("bad frame number")
    value = data[0] & (0x7F >> n)
    for b in data[1:n]:
        value = value << 6 | b & 0x3F
    return value, n


def _fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, ORDER) and shifts of least-squares predictors, by Levinson and Durbin's recursion."""
    n = x.shape[1]
    window = np.hanning(n + 2)[1:-1]
    w = x * window
    r = np.stack([(w[:, : n - k] * w[:, k:]).sum(axis=1) for k in range(ORDER + 1)], axis=1)
    err = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(top)).astype(np.int64) - 1, 0, 15)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def _encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of the rows of ``samples`` (int64), numbered as given: bytes and the length of each."""
    count = len(samples)
    each = np.arange(count)
    best = np.abs(samples).sum(axis=1)
    choice, residual = np.zeros(count, np.int64), samples.copy()
    diff = samples
    for order in range(1, 5):
        diff = np.diff(diff, axis=1)
        cost = np.abs(diff).sum(axis=1)
        better = cost < best
        best = np.where(better, cost, best)
        choice = np.where(better, order, choice)
        residual[better, order:] = diff[better]
    coef, shift = _fit(samples.astype(np.float64))
    pred = np.zeros((count, BLOCK - ORDER), np.int64)
    for j in range(ORDER):
        pred += coef[:, j : j + 1] * samples[:, ORDER - 1 - j : BLOCK - 1 - j]
    fitted = samples[:, ORDER:] - (pred >> shift[:, None])
    # the fitted predictor must pay for its coefficients
    better = np.abs(fitted).sum(axis=1) + 100 < best
    choice = np.where(better, 32 + ORDER - 1, choice)
    residual[better, ORDER:] = fitted[better]
    order = np.where(choice >= 32, ORDER, choice)

    parts = 1 << PARTITIONS
    coded = np.arange(BLOCK)[None, :] >= order[:, None]
    u = np.where(coded, np.where(residual < 0, -2 * residual - 1, 2 * residual), 0).astype(np.int64)
    cut = u.reshape(count, parts, -1)
    n_coded = coded.reshape(count, parts, -1).sum(axis=2)
    sizes = np.stack([(cut >> k).sum(axis=2) + n_coded * (k + 1) for k in range(13)])
    param = sizes.argmin(axis=0)
    k = np.repeat(param, BLOCK // parts, axis=1)
    q = u >> k
    length = np.where(coded, q + 1 + k, 0)
    length[:, :: BLOCK // parts] += 4  # a partition's parameter goes ahead of its first code

    heads = []
    for i in numbers.tolist():
        h = b"\xff\xf8\x20\x02" + _coded(i)
        heads.append(h + bytes([crc8(h)]))
    head_len = np.array([len(h) for h in heads])
    side = 8 + 8 * order + np.where(choice >= 32, 9 + PRECISION * ORDER, 0) + 6
    body = 8 * head_len + side + length.sum(axis=1)
    frame_len = -(-body // 8) + 2
    starts = np.concatenate([[0], np.cumsum(frame_len)[:-1]])
    bits = np.zeros(8 * int(frame_len.sum()), np.uint8)

    def put(at: np.ndarray, value: np.ndarray, n: int) -> None:
        for b in range(n):
            bits[at + b] = value >> (n - 1 - b) & 1

    at = 8 * (starts + head_len)
    put(at, np.where(choice >= 32, choice, choice + 8) << 1, 8)
    at = at + 8
    for j in range(ORDER):
        has = order > j
        put((at + 8 * j)[has], samples[has, j] & 0xFF, 8)
    at = at + 8 * order
    fit = choice >= 32
    put(at[fit], np.full(int(fit.sum()), PRECISION - 1), 4)
    put(at[fit] + 4, shift[fit], 5)
    for j in range(ORDER):
        put(at[fit] + 9 + PRECISION * j, coef[fit, j] & ((1 << PRECISION) - 1), PRECISION)
    at = at + np.where(fit, 9 + PRECISION * ORDER, 0)
    put(at, np.full(count, PARTITIONS), 6)
    at = at + 6
    ends = at[:, None] + np.cumsum(length, axis=1)
    for p in range(parts):
        first = p * (BLOCK // parts)
        put(at if p == 0 else ends[:, first - 1], param[:, p], 4)
    code = (ends - (q + 1 + k))[coded]  # where each code begins
    q, k, u = q[coded], k[coded], u[coded]
    code += q
    bits[code] = 1
    for b in range(int(k.max(initial=0))):
        has = k > b
        bits[code[has] + 1 + b] = u[has] >> (k[has] - 1 - b) & 1
    data = np.packbits(bits)
    for i, h, a in zip(each.tolist(), heads, starts.tolist(), strict=True):
        data[a : a + len(heads[i])] = np.frombuffer(h, np.uint8)
    crc = crc16_of(data, starts, frame_len - 2)
    data[starts + frame_len - 2], data[starts + frame_len - 1] = crc >> 8, crc & 0xFF
    return data.tobytes(), frame_len


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 576."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError("not a positive multiple of the block size")
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    samples = (joined.astype(np.int64) - 128).reshape(-1, BLOCK)
    counts = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(n) for n in counts]) if counts else np.zeros(0, np.int64)
    coded, lengths = [], []
    for k in range(0, len(samples), TOGETHER):
        data, length = _encode_frames(samples[k : k + TOGETHER], numbers[k : k + TOGETHER])
        coded.append(data)
        lengths.append(length)
    data = b"".join(coded)
    lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out, frame = [], 0
    for p, n in zip(payloads, counts, strict=True):
        own = lengths[frame : frame + n]
        offsets = ends[frame : frame + n] - ends[frame]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("length", ">u2")]))
        points["sample"], points["offset"], points["length"] = np.arange(n) * BLOCK, offsets, BLOCK
        seek = points.tobytes()
        head = b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
        out.append(head + data[ends[frame] : ends[frame + n]])
        frame += n
    return out


def _metadata(stream: bytes) -> tuple[int, int, bytes, np.ndarray, int]:
    """Block size, samples, MD5, seek points and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, np.zeros(0, np.int64)
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            low, high = struct.unpack(">HH", block[:4])
            packed = int.from_bytes(block[10:18], "big")
            if low != high or packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise ValueError("only 8-bit mono of one block size")
            info = low, packed & ((1 << 36) - 1), block[18:34]
        elif kind == 3:
            table = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("length", ">u2")]))
            points = table["offset"][table["length"] > 0].astype(np.int64)
        at += 4 + size
    if info is None:
        raise ValueError("no STREAMINFO")
    return *info, points, at


def _decode_frames(data: np.ndarray, words: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames that begin at ``starts``: samples (block, frames), frame numbers and ends."""
    count = len(starts)
    numbers, pos = np.zeros(count, np.int64), np.zeros(count, np.int64)
    sizes = {0b0010: 576}
    for i, s in enumerate(starts.tolist()):
        head = data[s : s + 16].tobytes()
        if len(head) < 6 or head[:2] != b"\xff\xf8" or head[3] not in (0x02, 0x00) or sizes.get(head[2] >> 4, -1) != block or head[2] & 15 > 11:
            raise ValueError("bad frame header")
        numbers[i], n = _uncoded(head[4:])
        if crc8(head[: 4 + n]) != head[4 + n]:
            raise ValueError("a frame header fails its checksum")
        pos[i] = 8 * (s + 5 + n)

    def look(at: np.ndarray) -> np.ndarray:
        """At least 57 bits from ``at``, at the top of 64."""
        return words[at >> 3] << (at & 7).astype(np.uint64)

    def take(n: int, where: np.ndarray | None = None) -> np.ndarray:
        """The next n bits, of the frames of a mask if one is given."""
        at = pos if where is None else pos[where]
        value = (look(at) >> np.uint64(64 - n)).astype(np.int64)
        if where is None:
            pos[:] += n
        else:
            pos[where] += n
        return value

    def signed(value: np.ndarray, n: int) -> np.ndarray:
        return np.where(value >= 1 << (n - 1), value - (1 << n), value)

    kind = take(8)
    if (kind & 0x81).any():
        raise ValueError("bad subframe header")
    kind = kind >> 1
    constant, plain = kind == 0, kind == 1
    fixed, fitted = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | plain | fixed | fitted).all():
        raise ValueError("unknown subframe")
    order = np.where(fitted, kind - 31, np.where(fixed, kind - 8, 0))
    most = int(order.max(initial=0))
    x = np.zeros((block + most, count), np.int64)  # rows before the first sample stay zero
    for s in range(most):
        has = order > s
        x[most + s, has] = signed(take(8, has), 8)
    coef, shift = np.zeros((most, count), np.int64), np.zeros(count, np.int64)
    for o in range(1, 5):
        for j, c in enumerate(FIXED[o]):
            coef[j : j + 1, fixed & (order == o)] = c
    if fitted.any():
        precision = take(4, fitted) + 1
        shift[fitted] = take(5, fitted)
        if (precision > 15).any() or (shift > 15).any():
            raise ValueError("bad predictor")
        wide = np.zeros(count, np.int64)
        wide[fitted] = precision
        for p in np.unique(precision).tolist():
            for j in range(most):
                has = fitted & (wide == p) & (order > j)
                coef[j, has] = signed(take(p, has), p)
    for i in np.flatnonzero(constant).tolist():
        one = np.arange(count) == i
        x[most:, i] = signed(take(8, one), 8)
    for s in range(block if plain.any() else 0):
        x[most + s, plain] = signed(take(8, plain), 8)
    rice = fixed | fitted
    sub = np.flatnonzero(rice)
    if len(sub):
        method = take(2, rice)
        parts = take(4, rice)
        if method.max() > 1 or (block % (1 << parts.max())):
            raise ValueError("bad residual")
        per = block >> parts  # samples in a partition
        bits_of = np.where(method == 1, 5, 4)
        at, first = pos[sub], order[sub]
        k, raw = np.zeros(len(sub), np.int64), np.full(len(sub), -1, np.int64)
        e, c, sh = np.zeros((block, len(sub)), np.int64), coef[:, sub], shift[sub]
        least = int(first.min())
        per_min = int(per.min())
        for s in range(block):
            if s % per_min == 0:
                new = s % per == 0
                value = (look(at) >> (64 - bits_of).astype(np.uint64)).astype(np.int64)
                k = np.where(new, value, k)
                at = at + np.where(new, bits_of, 0)
                escape = new & (value == (1 << bits_of) - 1)
                raw = np.where(new, -1, raw)
                if escape.any():
                    raw = np.where(escape, (look(at) >> np.uint64(59)).astype(np.int64), raw)
                    at = at + np.where(escape, 5, 0)
            if s < least:
                continue
            win = look(at)
            top = win >> np.uint64(32)
            q = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
            none = top == 0
            if none.any():  # 32 zeros or more
                none &= (raw < 0) & (s >= first)
                ahead = at + np.where(none, 32, 0)
                while none.any():
                    t = look(ahead) >> np.uint64(32)
                    none = none & (t == 0)
                    ahead = ahead + np.where(none, 32, 0)
                    if (ahead >> 3 >= len(words)).any():
                        raise ValueError("a frame runs over the end")
                t = look(ahead) >> np.uint64(32)
                q = np.where(top == 0, ahead - at + 32 - np.frexp(t.astype(np.float64))[1], q)
                win = look(at + q)
                rest = win << np.uint64(1)
            else:
                rest = win << (q + 1).astype(np.uint64)
                if (q + k).max() > 55:
                    rest = look(at + q + 1)
            u = q << k | ((rest >> np.uint64(1)) >> (63 - k).astype(np.uint64)).astype(np.int64)
            value = (u >> 1) ^ -(u & 1)
            used = q + 1 + k
            if (raw >= 0).any():
                n = np.maximum(raw, 1)
                v = (look(at) >> (64 - n).astype(np.uint64)).astype(np.int64)
                v = np.where(raw > 0, np.where(v >= 1 << (n - 1), v - (1 << n), v), 0)
                value, used = np.where(raw >= 0, v, value), np.where(raw >= 0, raw, used)
            coded = s >= first
            e[s] = np.where(coded, value, 0)
            at = at + np.where(coded, used, 0)
            if (at >> 3 >= len(words)).any():
                raise ValueError("a frame runs over the end")
        pos[sub] = at
        y = x[:, sub]
        for s in range(least, block):
            guess = (c * y[s : s + most][::-1]).sum(axis=0) >> sh if most else 0
            y[most + s] = np.where(s >= first, guess + e[s], y[most + s])
        x[:, sub] = y
    ends = -(-pos // 8) + 2
    if (ends > len(data)).any():
        raise ValueError("a frame runs over the end")
    stored = data[ends - 2].astype(np.int64) << 8 | data[ends - 1]
    if (crc16_of(data, starts, ends - 2 - starts) != stored).any():
        raise ValueError("a frame fails its checksum")
    if np.abs(x + 0.5).max(initial=0) > 128:
        raise ValueError("a sample is out of range")
    return x[most:], numbers, ends


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """For each stream its payload and its frames: (first sample, byte offset, bytes) by row."""
    infos = [_metadata(s) for s in streams]
    if len({i[0] for i in infos}) > 1:
        raise ValueError("streams of several block sizes")
    block = infos[0][0] if infos else BLOCK
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    data = np.frombuffer(b"".join(streams), np.uint8)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words |= wide[k : k + len(data)] << np.uint64(56 - 8 * k)
    frames = [-(-i[1] // block) for i in infos]
    samples = [np.zeros((n, block), np.uint8) for n in frames]
    spans = [np.zeros((n, 3), np.int64) for n in frames]

    def read(owner: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x, numbers, ends = _decode_frames(data, words, starts, block)
        if (numbers != index).any():
            raise ValueError("frames out of order")
        rows = (x.T + 128).astype(np.uint8)
        for j, (d, i, s, t) in enumerate(zip(owner.tolist(), index.tolist(), starts.tolist(), ends.tolist(), strict=True)):
            samples[d][i] = rows[j]
            spans[d][i] = (i * block, s - base[d], t - s)
        return ends

    full = [d for d, i in enumerate(infos) if len(i[3]) == frames[d]]
    owner = np.repeat(np.array(full, np.int64), [frames[d] for d in full]) if full else np.zeros(0, np.int64)
    index = np.concatenate([np.arange(frames[d]) for d in full]) if full else np.zeros(0, np.int64)
    starts = np.concatenate([base[d] + infos[d][4] + infos[d][3] for d in full]) if full else np.zeros(0, np.int64)
    for k in range(0, len(owner), TOGETHER):
        read(owner[k : k + TOGETHER], index[k : k + TOGETHER], starts[k : k + TOGETHER])
    now = {d: base[d] + infos[d][4] for d in range(len(streams)) if d not in set(full)}
    step = 0
    while now := {d: s for d, s in now.items() if step < frames[d]}:  # one frame of each stream that is left
        ends = read(np.array(list(now)), np.full(len(now), step), np.array(list(now.values())))
        now = dict(zip(now, ends.tolist(), strict=True))
        step += 1
    out = []
    for d, (_, total, md5, _, begin) in enumerate(infos):
        at = spans[d]
        if len(at) and (at[0, 1] != begin or (at[1:, 1] != at[:-1, 1] + at[:-1, 2]).any() or at[-1, 1] + at[-1, 2] != len(streams[d])):
            raise ValueError("frames don't follow one another")
        payload = samples[d].reshape(-1)[:total]
        if hashlib.md5((payload ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the samples fail their checksum")
        out.append((payload.tobytes(), at))
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, filled up with 255 to a positive multiple of 576, and their number before that."""
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % BLOCK or (0 if raw else BLOCK)), len(raw)


def feature_of(payload: bytes, frames: np.ndarray) -> str:
    """Level, zero crossings and mean step of the samples, and the spread of frame sizes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    rms = float(np.sqrt((x * x).mean()))
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"rms={rms:.4f};crossings={crossings};step={float(np.abs(np.diff(x)).mean()):.4f};frames={len(frames)};frame_bytes={int(frames[:, 2].min())}-{int(frames[:, 2].max())}"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def to_media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media binary): each text's payload as a FLAC stream."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("media", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, size=TOGETHER * BLOCK):
                both = [payload_of(t) for t in texts]
                yield batch_of(fields, {"doc_id": ids[first : first + len(texts)], "n_bytes": [n for _, n in both], "media": encode([p for p, _ in both])})

    return _texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def to_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks (doc_id, block, first_sample, media_offset, pcm binary) of streams (doc_id, media), read back and verified."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("block", pa.int64()), pa.field("first_sample", pa.int64()), pa.field("media_offset", pa.int64()), pa.field("pcm", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 100):
                part = batch.slice(k, 100)
                out: dict[str, list] = {f.name: [] for f in fields}
                for i, (payload, frames) in zip(part.column(0).to_pylist(), decode(part.column(1).to_pylist()), strict=True):
                    for b, (first, offset, _) in enumerate(frames.tolist()):
                        out["doc_id"].append(i)
                        out["block"].append(b)
                        out["first_sample"].append(first)
                        out["media_offset"].append(offset)
                        out["pcm"].append(payload[first : first + BLOCK])
                yield batch_of(fields, out)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, block long, first_sample long, media_offset long, pcm binary")


DIGEST = [
    pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("payload_bytes", pa.int64()), pa.field("payload_sha256", pa.string()),
    pa.field("tail_crc32", pa.int64()), pa.field("media_bytes", pa.int64()), pa.field("media_sha256", pa.string()), pa.field("feature", pa.string()),
]


def digest(docs: DataFrame) -> DataFrame:
    """Encodes each text and reads the stored bytes back, in one pass; a row of digests for each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, size=TOGETHER * BLOCK):
                sizes, media = zip(*(payload_of(t)[::-1] for t in texts), strict=True)
                media = encode(list(media))
                read = decode(media)
                yield batch_of(DIGEST, {
                    "doc_id": ids[first : first + len(texts)], "n_bytes": list(sizes),
                    "payload_bytes": [len(p) for p, _ in read], "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _ in read],
                    "tail_crc32": [zlib.crc32(p[-32:]) for p, _ in read],
                    "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                    "feature": [feature_of(p, f) for p, f in read],
                })

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _texts(docs).mapInArrow(run, ddl)
