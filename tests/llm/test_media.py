import struct

import pytest

from tidemark.llm import media
from tidemark.llm.media import box, full_box


def test_round_trip_and_ranges():
    payload = bytes(range(256)) * 600
    data = media.write_container(payload)
    facts = media.describe(data)
    assert (facts["codec"], facts["handler"], facts["timescale"], facts["duration"], facts["error"]) == ("ipcm", "soun", 8000, len(payload), None)
    assert facts["n_samples"] == len(payload) // 64 and facts["n_keyframes"] == 3
    assert b"".join(data[s["offset"]:s["offset"] + s["length"]] for s in facts["samples"]) == payload
    for k, at in zip(facts["keyframes"], range(0, len(payload), 65_536), strict=True):
        assert data[k["offset"]:k["offset"] + k["length"]] == payload[at:at + 64]
    with pytest.raises(ValueError):
        media.write_container(b"x")


def track(samples, version=0, wide=False, stss=None, stsc=((1, 2, 1),), offsets=(40, 60)):
    n = len(samples)
    stbl = [full_box(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full_box(b"stts", struct.pack(">III", 1, n, 10)),
            full_box(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *r) for r in stsc)),
            full_box(b"stsz", struct.pack(">II", 0, n), *(struct.pack(">I", s) for s in samples)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), *(struct.pack(">Q" if wide else ">I", o) for o in offsets))]
    if stss:
        stbl.append(full_box(b"stss", struct.pack(">I", len(stss)), *(struct.pack(">I", s) for s in stss)))
    times = struct.pack(">QQIQ", 0, 0, 600, 90) if version else struct.pack(">IIII", 0, 0, 600, 90)
    return box(b"trak", box(b"mdia", full_box(b"mdhd", times, bytes(4), version=version), full_box(b"hdlr", bytes(4), b"vide", bytes(13)),
                            box(b"minf", box(b"stbl", *stbl))))


@pytest.mark.parametrize("version,wide", [(0, False), (1, True)])
def test_foreign_layout(version, wide):
    lead = struct.pack(">I", 1) + b"free" + struct.pack(">Q", 100) + bytes(84)  # a box with a 64-bit size
    data = lead + box(b"moov", box(b"trak"), track([5, 6, 7], version, wide, stss=[1, 3], stsc=((1, 2, 1), (2, 1, 1)))) + struct.pack(">I", 0) + b"mdat" + bytes(50)
    facts = media.describe(data)
    assert (facts["codec"], facts["timescale"], facts["duration"], facts["n_samples"], facts["error"]) == ("avc1", 600, 90, 3, None)
    assert [(k["offset"], k["length"]) for k in facts["keyframes"]] == [(40, 5), (60, 7)]
    assert [(k["offset"], k["length"]) for k in facts["samples"]] == [(40, 11), (60, 7)]


def test_all_samples_are_keyframes_without_a_sync_table():
    facts = media.describe(box(b"moov", track([4, 4], offsets=(0,))) + bytes(20))
    assert facts["n_keyframes"] == 2


def test_broken_files():
    good = media.write_container(bytes(64))
    for data in (b"", b"abc", good[:100], b"not a media file at all", box(b"moov"), box(b"moov", track([4] * 9)), good[:-1] + b"", box(b"moov", track([900, 900]))):
        facts = media.describe(data)
        assert facts["error"] and facts["codec"] is None and facts["keyframes"] is None, data[:20]


def test_columns(docs, extra):
    df = extra(docs([(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (5, "long " * 60_000), (4, "x" * 65)])).withColumn("payload", media.payload_of("text"))
    rows = media.media_columns(media.store(df)).withColumn("read", media.sample_bytes("media", "facts")).collect()
    for r in rows:
        data = (r.text or "").encode()
        want = data + bytes(-len(data) % 64 if data else 64)
        assert bytes(r.payload) == want == bytes(r.read) and r.facts.error is None and r.score == "clash"
    assert len({bytes(r.media) for r in rows if r.doc_id == 4}) == 1
    none = media.media_columns(media.store(df.limit(1).selectExpr("CAST(NULL AS binary) AS payload"))).first()
    assert none.media is None and none.facts.error and none.facts.codec is None
    assert media.media_columns(media.store(docs([]).withColumn("payload", media.payload_of("text")))).collect() == []


def test_split_runs_read_in_order(spark):
    data = bytes(range(100))
    df = spark.createDataFrame([(bytearray(data), ([(10, 3), (50, 2)],))], "media binary, facts struct<samples:array<struct<offset:bigint,length:bigint>>>")
    assert bytes(df.select(media.sample_bytes("media", "facts").alias("r")).first().r) == data[10:13] + data[50:52]


def test_every_track_and_fragments():
    import struct

    one, two = media.write_container(b"a" * 128), media.write_container(b"b" * 64)
    at = one.index(b"moov") - 4
    size = int.from_bytes(one[at:at + 4], "big")
    other = two.index(b"trak") - 4
    track = two[other:other + int.from_bytes(two[other:other + 4], "big")]
    # a second track beside the first; chunk places are not moved, so both read from the file that there is
    both = one[:at] + struct.pack(">I", size + len(track)) + one[at + 4:at + size] + track + one[at + size:]
    found = media.describe(both)
    assert found["error"] is None and [t["n_samples"] for t in found["tracks"]] == [2, 1] and found["n_samples"] == 2
    assert found["tracks"][0]["codec"] == found["codec"] and "samples" not in found["tracks"][0]
    cut = media.describe(one + struct.pack(">I", 8) + b"moof")
    assert "moof" in cut["error"] and cut["codec"] is None and cut["tracks"] is None
