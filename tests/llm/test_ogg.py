import hashlib
import random
import struct
import zlib

from orbweave.llm import ogg
from tests.llm.helpers import docs_frame, odd_rows


def plain_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 7, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == plain_crc(data)


def test_streams_survive_the_container():
    rng = random.Random(2)
    for _ in range(60):
        streams = {s: [(rng.randbytes(rng.choice([0, 1, 254, 255, 256, 510, 3_000, 70_000])), i) for i in range(rng.randint(1, 7))] for s in (5, 6, 900)}
        found, bad = ogg.demux(ogg.mux(streams))
        assert not bad and set(found) == set(streams)
        for s, packets in streams.items():
            assert found[s].packets == [p for p, _ in packets] and found[s].closed and not found[s].lost
            assert found[s].ends[-1] == packets[-1][1]


def test_texts_survive_and_times_come_from_granules():
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 4_095, 4_096, 4_097, 61_440, 65_026, 300_001):
        data = rng.randbytes(n)
        audio = ogg.decode_audio(ogg.encode_text(data))
        size = max(64, -(-n // 64) * 64)
        assert audio.length == n and audio.samples == data + bytes(size - n) and not audio.bad
        assert audio.times == [min(size, (i + 1) * ogg.FRAME) / ogg.RATE for i in range(-(-size // ogg.FRAME))]


def test_damage_is_found():
    media = bytearray(ogg.encode_text(random.Random(4).randbytes(300_000)))
    media[70_000] ^= 1
    streams, bad = ogg.demux(bytes(media))
    assert bad >= 1 and streams[ogg.AUDIO].lost == 1
    whole = ogg.decode_audio(ogg.encode_text(random.Random(4).randbytes(300_000)))
    assert len(ogg.decode_audio(bytes(media)).samples) < len(whole.samples)
    assert ogg.decode_audio(b"") is None and ogg.decode_audio(b"OggS") is None and ogg.decode_audio(b"noise") is None
    assert ogg.demux(bytes(media[:100]))[1] >= 1


def test_rows(spark):
    df = docs_frame(spark)
    got = ogg.read(ogg.store(df)).collect()
    assert len(got) == len(odd_rows())
    want = {}
    for row in odd_rows():
        data = (row[1] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        want.setdefault(row[0], set()).add((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
        assert r["bad_pages"] == 0 and r["feature"]
    by_text = {r["payload_sha256"]: (r["media_sha256"], r["feature"]) for r in got}
    assert all(by_text[r["payload_sha256"]] == (r["media_sha256"], r["feature"]) for r in got)
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"nothing")), (3, bytearray(ogg.mux({9: [(b"other", 0)]})))], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in ogg.read(odd).collect()}
    assert rows[1]["media_bytes"] is None and rows[2]["feature"] is None and rows[3]["media_bytes"] > 0 and rows[3]["payload_bytes"] is None
    assert ogg.read(ogg.store(docs_frame(spark, []))).count() == 0
    assert struct.calcsize("<4sBBqIIIB") == 27
