import hashlib
import random
import zlib

from molframe.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    r = random.Random(1)
    for n in (0, 1, 5, 300):
        data = r.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)


def test_round_trip_and_times():
    r = random.Random(2)
    for n in (192, 192 * 21, 192 * 22, 192 * 1000, 192 * 3001):
        data = r.randbytes(n)
        streams, bad = ogg.demux(ogg.mux(data))
        back, _ = ogg.features(streams, bad)
        assert back == data and bad == 0 and sorted(streams) == [1, 2] and all(s.ended and not s.lost for s in streams.values())
        times = ogg.timestamps(streams[1], ogg.RATE)
        at = 0
        for p, t in zip(streams[1].packets[1:], times[1:], strict=True):
            at += len(p)
            assert t == at / ogg.RATE


def test_packets_of_all_sizes():
    packets = [bytes([i % 7]) * n for i, n in enumerate([3, 0, 255, 254, 256, 510, 65025, 65026, 70000, 1])]
    streams, bad = ogg.demux(b"".join(ogg.stream_pages(5, packets, list(range(len(packets))))))
    assert streams[5].packets == packets and not bad


def test_damage_is_found():
    data = ogg.mux(bytes(192 * 2000))
    hurt = bytearray(data)
    hurt[len(data) // 2] ^= 1
    streams, bad = ogg.demux(bytes(hurt))
    assert bad >= 1 and streams[1].lost == 1 and len(streams[1].packets) < len(ogg.demux(data)[0][1].packets)
    assert ogg.demux(b"junk" + data + b"junk")[0][1].packets == ogg.demux(data)[0][1].packets
    assert ogg.demux(None) == ({}, 0)


def test_query_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    for r in ogg.op9_ogg(spark, "/root/testdata/sf0.001").collect():
        n, payload = ogg.payload_of(want[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "é" * 96, 0), (2, "", 0)], "doc_id long, text string, media int")
    rows = ogg.ogg_round_trip(df).collect()
    assert [r.payload_bytes for r in rows] == [192] * 4 and rows[0].media_sha256 == rows[1].media_sha256
    packets = ogg.ogg_packets(ogg.ogg_encode(df)).filter("serial = 1 and packet = 1").collect()
    assert len(packets) == 4 and bytes([p.data for p in packets if p.doc_id is None][0]).decode() == "é" * 96
    assert ogg.ogg_round_trip(df.limit(0)).count() == 0
