import hashlib
import zlib

import pytest

from sampleloom.llm import ogg


def slow_checksum(page):
    r = 0
    for x in page:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_checksum_is_the_bitwise_one():
    for page in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.page_checksum(page) == slow_checksum(page)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 4096, 4097, 8192, 131072, 400000])
@pytest.mark.parametrize("streams", [1, 2, 3])
def test_round_trip_and_times(n, streams):
    payload, n_bytes = ogg.padded("é" * (n // 2) + "x" * (n % 2))
    assert len(payload) % 64 == 0 and payload
    media = ogg.mux(payload, n_bytes, streams)
    found, sound, damaged = ogg.demux(media)
    assert damaged == 0 and ogg.payload_of(found) == (payload, n_bytes)
    for packets in found.values():
        at = 0
        for start, end, data in packets[1:]:
            assert (start, end) == (at, at + len(data))
            at = end


def test_damage_is_found_and_the_rest_read():
    payload, n = ogg.padded("abc" * 100000)
    media = bytearray(ogg.mux(payload, n))
    media[len(media) // 2] ^= 1
    found, sound, damaged = ogg.demux(bytes(media))
    assert damaged >= 1
    whole = ogg.demux(ogg.mux(payload, n))[0]
    for serial, packets in found.items():
        assert set(packets) <= set(whole[serial])  # what is left keeps its times and bytes
    assert sum(map(len, found.values())) < sum(map(len, whole.values()))


def test_a_lost_end_is_a_fault(spark):
    """Cut files, files without their last page or with bytes behind it, and streams that go on behind their last page."""
    payload, n = ogg.padded("abc" * 100000)
    media = ogg.mux(payload, n)
    starts = [i for i in range(len(media)) if media.startswith(b"OggS", i)]
    cases = {"whole": media, "cut": media[:-3000], "cut by a byte": media[:-1], "no last page": media[: starts[-1]], "only heads": media[: starts[2]], "bytes behind": media + b"x", "bytes before": b"y" + media, "twice": media + media, "empty": b""}
    rows = [(k, v) for k, v in cases.items()]
    out = {r.doc_id: r for r in ogg.media_digests(spark.createDataFrame(rows, "doc_id string, media binary")).collect()}
    assert {k for k, r in out.items() if r.n_damaged == 0} == {"whole"}
    assert out["bytes behind"].payload_bytes == out["bytes before"].payload_bytes == len(payload) > out["cut by a byte"].payload_bytes
    found, sound, damaged = ogg.demux(media[: starts[-1]])
    assert damaged == 1 and sound == len(starts) - 1


def test_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "ü" * 70000), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as media")
    out = ogg.media_digests(ogg.mux_texts(docs)).collect()
    assert len(out) == 6
    by = {(r.doc_id, r.n_bytes): r for r in out}
    for key, text in rows:
        payload, n = ogg.padded(text or "")
        r = by[key, n]
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.n_damaged == 0
    assert by[3, 1].media_sha256 == by[5, 1].media_sha256 and by[3, 1].feature == by[5, 1].feature
    packets = ogg.demux_packets(ogg.mux_texts(docs)).where("doc_id is null and packet > 0").orderBy("start_s", "serial").collect()
    assert b"".join(bytes(p.data) for p in packets)[: 140000] == ("ü" * 70000).encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ogg.media_digests(ogg.mux_texts(docs)).count() == 0
