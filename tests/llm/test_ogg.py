import random
import struct

import pytest

from quirelake.llm import ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def packets(rng, n, most):
    return [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 254, 255, 256, 510, rng.randint(0, most)]))) for _ in range(n)]


def test_checksum_is_the_bitwise_one():
    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("seed", range(4))
def test_round_trip(seed):
    rng = random.Random(seed)
    want = {s: packets(rng, 20, 70_000 if s == 3 else 2000) for s in (3, 7, 9)}
    data = ogg.write({s: [(p, 10 * i) for i, p in enumerate(ps)] for s, ps in want.items()}, page_bytes=600)
    got, bad = ogg.read(b"junk OggS" + data + b"OggS tail")
    assert bad == 2
    assert {s: [p for p, _ in x.packets] for s, x in got.items()} == want
    assert all(x.lost == 0 and x.end_granule == 190 for x in got.values())


def pages(data):
    at, out = 0, []
    while at < len(data):
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        out.append(data[at:end])
        at = end
    return out


def test_damage_loses_only_what_it_touches():
    data = ogg.write({1: [(bytes([i]) * 900, i) for i in range(12)]}, page_bytes=300)
    parts = pages(data)
    assert len(parts) == 12
    broken = bytearray(parts[5])
    broken[-1] ^= 1
    got, bad = ogg.read(b"".join(parts[:5]) + bytes(broken) + b"".join(parts[6:]))
    assert bad == 1 and [p[0] for p, _ in got[1].packets] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]


def test_packet_over_a_missing_page_is_lost():
    data = ogg.write({1: [(b"head", 0), (b"a" * 200_000, 1), (b"end", 2)]})
    parts = pages(data)
    assert len(parts) == 6  # head, four full ones of 255 lacing values or the rest, end
    got, _ = ogg.read(parts[0] + parts[1] + b"".join(parts[3:]))
    assert [p for p, _ in got[1].packets][0] == b"head" and got[1].lost == 1
    assert b"a" * 200_000 not in [p for p, _ in got[1].packets]


def test_codecs_and_times():
    speex = b"Speex   " + bytes(28) + struct.pack("<I", 8000) + bytes(40)
    flac = b"\x7fFLAC" + bytes(22) + (44_100 << 4).to_bytes(3, "big") + bytes(20)
    got, _ = ogg.read(ogg.write({k: [(h, 0), (b"x", 88_200)] for k, h in enumerate((ogg.OPUS_HEAD, ogg.VORBIS_HEAD, speex, flac, b"other"))}))
    assert [(s.codec, s.rate) for s in got.values()] == [("opus", 48_000), ("vorbis", 16_000), ("speex", 8000), ("flac", 44_100), (None, None)]
    assert got[0].time(48_312) == 1.0 and got[3].time(88_200) == 2.0 and got[4].time(1) is None


def test_edges(spark):
    rows = [(1, "a\nbb", "x"), (2, None, None), (None, "", "y"), (3, "z" * 3_000_000, None), (1, "a\nbb", "x")]
    got = ogg.streams(ogg.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, serial string"))).collect()
    assert sorted((r.doc_id or 0, r.serial, r.packets, r.payload_bytes, r.lost_runs) for r in got) == [(0, 0, 2, 19, 0), (0, 1, 1, 30, 0), (1, 0, 2, 20, 0), (1, 0, 2, 20, 0), (1, 1, 2, 32, 0), (1, 1, 2, 32, 0), (3, 0, 2, 3_000_019, 0), (3, 1, 1, 30, 0)]
    assert ogg.streams(spark.createDataFrame([], "doc_id long, ogg binary")).count() == 0


def runs(want, got):
    """Runs of packets of ``want`` that aren't in ``got``; the packets are all different."""
    missing = [p not in got for p in want]
    return sum(m and (i == 0 or not missing[i - 1]) for i, m in enumerate(missing))


@pytest.mark.parametrize("seed", range(6))
def test_lost_runs_for_every_set_of_dropped_pages(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([3, 200, 254, 255, 600, 70_000]) for _ in range(rng.randint(3, 6))]
    want = [bytes([i]) + rng.randbytes(n) for i, n in enumerate(sizes)]
    parts = pages(ogg.write({5: [(p, 10 * i) for i, p in enumerate(want)]}, page_bytes=300))[:10]
    whole = len(pages(ogg.write({5: [(p, 10 * i) for i, p in enumerate(want)]}, page_bytes=300))) == len(parts)
    for keep in range(1, 1 << len(parts)):
        got, bad = ogg.read(b"".join(p for k, p in enumerate(parts) if keep >> k & 1))
        packets = [p for p, _ in got[5].packets]
        assert bad == 0 and packets == [p for p in want if p in packets]
        assert got[5].lost == runs(want, packets), (keep, sizes, whole)


def test_page_times():
    data = ogg.write({1: [(ogg.VORBIS_HEAD, 0), (b"a" * 5000, 16_000), (b"b", 24_000), (b"c" * 70_000, 32_000)]})
    got, _ = ogg.read(data)
    assert got[1].granules == [0, 16_000, 24_000, 32_000]
    assert [got[1].time(g) for g in got[1].granules] == [0, 1.0, 1.5, 2.0]


def test_damage_of_the_query():
    data = ogg.text_to_ogg("one\ntwo\nthree")
    got, bad = ogg.read(ogg.harm(2, data))
    assert bad == 1 and got[0].codec is None and got[0].lost == 1 and [p for p, _ in got[0].packets] == [b"one", b"three"]
    got, bad = ogg.read(ogg.harm(3, data))
    assert bad == 1 and [s.lost for s in got.values()] == [0, 0]
    assert ogg.harm(None, data) == data == ogg.harm(5, data)
