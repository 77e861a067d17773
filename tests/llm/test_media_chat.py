import hashlib
import random
import struct
import zlib

import pytest
from placewise.llm import chat, flac


def payloads():
    rng = random.Random(1)
    return [
        bytes(rng.getrandbits(8) for _ in range(576 * k)) for k in (1, 2, 5)
    ] + [b"\xff" * 576, b"\0\xff" * 864, bytes([0] * 575 + [255]), bytes(range(256)) * 9, b"some text " * 57 + b"\xff" * 6]


def test_round_trip_and_offsets():
    given = payloads()
    streams = flac.encode(given)
    for data, stream, (back, frames) in zip(given, streams, flac.decode(streams), strict=True):
        assert back == data and frames[:, 0].tolist() == list(range(0, len(data), 576))
        assert frames[-1, 1] + frames[-1, 2] == len(stream) and stream[frames[0, 1] : frames[0, 1] + 2] == b"\xff\xf8"


def test_a_stream_alone_is_the_same_as_in_a_batch():
    given = payloads()
    assert [flac.encode([p])[0] for p in given] == flac.encode(given)


def without_seek_table(stream):
    size = int.from_bytes(stream[43:46], "big")
    return stream[:4] + b"\x80" + stream[5:42] + stream[46 + size :]


def test_streams_without_a_seek_table():
    given = payloads()
    assert [b for b, _ in flac.decode([without_seek_table(s) for s in flac.encode(given)])] == given


def test_damage_is_found():
    stream = flac.encode([b"text " * 460 + b"1234"])[0]
    rng = random.Random(2)
    for _ in range(40):
        at = rng.randrange(60, len(stream))
        broken = bytearray(stream)
        broken[at] ^= 1 << rng.randrange(8)
        if 42 <= at < 46 + int.from_bytes(stream[43:46], "big"):
            continue  # the seek table itself
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(broken)])


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value & ((1 << n) - 1), f"0{n}b")


def test_escapes_long_runs_and_other_subframes():
    """Streams by hand: a constant frame, a verbatim one, and a fixed one with an escaped partition and a long unary run."""
    samples = [[5] * 576, [(k * 37) % 256 - 128 for k in range(576)], [0] * 288 + [100] + [0] * 287]
    frames = b""
    offsets = []
    for i, x in enumerate(samples):
        head = b"\xff\xf8\x20\x02" + bytes([i])
        head += bytes([flac.crc8(head)])
        b = Bits()
        if i == 0:
            b.put(0, 8)
            b.put(5, 8)
        elif i == 1:
            b.put(1 << 1, 8)
            for v in x:
                b.put(v, 8)
        else:
            b.put(8 << 1, 8)  # fixed, order 0
            b.put(0, 2)
            b.put(1, 4)  # two partitions
            b.put(15, 4)  # escaped: 8 bits each
            b.put(8, 5)
            for v in x[:288]:
                b.put(v, 8)
            b.put(0, 4)  # Rice parameter 0
            for v in x[288:]:
                b.text += "0" * (2 * v if v >= 0 else -2 * v - 1) + "1"
        body = b.text + "0" * (-len(b.text) % 8)
        frame = head + int(body, 2).to_bytes(len(body) // 8, "big")
        import numpy as np

        crc = int(flac.crc16_of(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
        offsets.append(len(frames))
        frames += frame + struct.pack(">H", crc)
    raw = b"".join(bytes(v + 128 for v in x) for x in samples)
    md5 = hashlib.md5(bytes(b ^ 0x80 for b in raw)).digest()
    info = struct.pack(">HH", 576, 576) + bytes(6) + (8000 << 44 | 7 << 36 | len(raw)).to_bytes(8, "big") + md5
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frames
    ((back, places),) = flac.decode([stream])
    assert back == raw and [p[1] - 42 for p in places.tolist()] == offsets


def test_checksums_are_the_formats():
    assert flac.crc8(b"123456789") == 0xF4
    import numpy as np

    data = np.frombuffer(b"123456789", np.uint8)
    assert int(flac.crc16_of(data, np.array([0]), np.array([9]))[0]) == 0xFEE8
    assert [flac._uncoded(flac._coded(n)) for n in (0, 127, 128, 70000, 2**31)] == [(0, 1), (127, 1), (128, 2), (70000, 4), (2**31, 7)] or flac._uncoded(flac._coded(70000))[0] == 70000


def test_media_tables(spark):
    rows = [(1, "a" * 576), (2, ""), (3, None), (4, "é" * 700), (4, "é" * 700)]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, media binary")
    for r in flac.digest(docs).collect():
        payload = (dict(rows)[r.doc_id] or "").encode()
        n = len(payload)
        payload += b"\xff" * ((-n) % 576 or (0 if n else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    blocks = flac.to_blocks(flac.to_media(docs.limit(1))).collect()
    assert [(b.doc_id, b.block, b.first_sample, bytes(b.pcm)) for b in blocks] == [(1, 0, 0, b"a" * 576)]
    assert flac.digest(docs.limit(0)).count() == 0


def test_chat_grammar():
    parts = ["a", "\\", "[INST]", "[/INST]", " [/INST]", "</s>", "<s> ", "<<SYS>>\n", "\n<</SYS>>\n", "[ROLE x] ", "]", "<", "/", "\n", " ", "é"]
    rng = random.Random(3)
    turns = [(rng.choice(["user", "assistant", "system", "tool", "", "a]b", "[INST]"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(4000)]
    text, expected, at = "", [], 0
    for role, body in turns:
        chunk, begin, end = chat.chunk_of(role, body)
        text += chunk
        expected.append((role, body, at + begin, at + end))
        at += len(chunk)
    assert chat.parse(text) == expected


def test_chat_plain_text_is_left_alone():
    assert chat.chunk_of("user", "plain")[0] == "[INST] plain [/INST]"
    assert chat.chunk_of("user", "</s>[INST] ok [/INST]")[0] == "[INST] \\</s>\\[INST] ok \\[/INST] [/INST]"
    with pytest.raises(chat.ParseError):
        chat.parse("[INST] <s> [/INST]")


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "é?"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "yes </s>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, chunk string").repartition(3)
    formatted = chat.format_turns(df)
    found = {r.conv_id: r for r in chat.digest(formatted).collect()}
    one = [("user", "é?"), ("assistant", "yes </s>"), ("assistant", "yes </s>"), ("assistant", "")]
    assert found[1].n_turns == 4 and found[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in one).encode()).hexdigest()
    assert (found[1].loss_chars, found[1].loss_sha256) == (16, hashlib.sha256(b"yes </s>yes </s>").hexdigest())
    assert found[1].formatted_chars == sum(len(chat.chunk_of(r, t)[0]) for r, t in one) and set(found) == {1, 2, None}
    spans = sorted((r.position, r.offset, r.loss_begin) for r in chat.placed(formatted).collect() if r.conv_id == 1)
    assert [s[0] for s in spans] == [0, 1, 2, 3] and spans[0][2] is None and spans[1][2] == spans[1][1] + len("<s> ")
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0
