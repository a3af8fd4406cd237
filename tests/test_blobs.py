"""State-file audit: golden frame, each damage class, u64 max, MMUL and WCNT."""

import struct
import zlib

from runledger.sources import blobs as B


def jobc(limit=610, nxt=377, found=89, seeded=1, recent=(233, 144, 55, 34), count=None, magic=0x4A4F4243, version=2, extra=b""):
    body = struct.pack("<IIQQQB", magic, version, limit, nxt, found, seeded)
    body += struct.pack("<I", len(recent) if count is None else count)
    body += b"".join(struct.pack("<Q", v) for v in recent) + extra
    return body + struct.pack("<I", zlib.crc32(body))


def test_golden_bytes():
    # Layout: magic, version, three u64, one u8, u32 count, count x u64, crc32.
    b = jobc()
    assert len(b) == 41 + 32
    assert b[:4] == b"CBOJ"


def _audit(spark, blobs, kind="jobc"):
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in blobs], "name string, content binary")
    return {r.name: r for r in B.audit(df, kind=kind).collect()}


def test_verdicts(spark):
    ok = jobc()
    flipped = bytearray(ok)
    flipped[10] ^= 0x01
    blobs = [
        ("ok", ok),
        ("short", ok[:10]),
        ("crc", bytes(flipped)),
        ("magic", jobc(magic=0x12345678)),
        ("version", jobc(version=99)),
        ("recent_cap", jobc(count=9999)),
        ("recent_size", jobc(count=8)),
        ("trailing", jobc(extra=b"\x00")),
        ("u64max", jobc(limit=2**64 - 1, nxt=2**64 - 1, found=2**64 - 1)),
    ]
    got = _audit(spark, blobs)
    for name in ("short", "crc", "magic", "version", "recent_cap", "recent_size", "trailing"):
        assert got[name].verdict == name
    r = got["ok"]
    assert (r.verdict, int(r.limit), int(r.next), int(r.found), r.seeded, r.recent_count) == ("ok", 610, 377, 89, True, 4)
    m = got["u64max"]
    assert m.verdict == "ok" and int(m.found) == 2**64 - 1 and int(m.limit) == 2**64 - 1


def test_mmul_and_wcnt(spark):
    mm = struct.pack("<IIQQQQ", 0x4D4D554C, 1, 30, 7, 900, 2**64 - 5)
    mm += struct.pack("<I", zlib.crc32(mm))
    got = _audit(spark, [("mm", mm), ("mm_short", mm[:43])], kind="mmul")
    assert got["mm"].verdict == "ok" and int(got["mm"].fingerprint) == 2**64 - 5 and int(got["mm"].n) == 30
    assert got["mm_short"].verdict == "short"
    wc = struct.pack("<IIQQQI", 0x57434E54, 1, 13, 5000, 5000, 2) + struct.pack("<IQ", 1, 10) + struct.pack("<IQ", 4, 20)
    wc += struct.pack("<I", zlib.crc32(wc))
    bad = struct.pack("<IIQQQI", 0x57434E54, 1, 13, 5000, 5000, 3) + struct.pack("<IQ", 1, 10)
    bad += struct.pack("<I", zlib.crc32(bad))
    got = _audit(spark, [("wc", wc), ("wc_size", bad)], kind="wcnt")
    assert got["wc"].verdict == "ok" and got["wc"].count_size == 2 and int(got["wc"].words_total) == 5000
    assert got["wc_size"].verdict == "recent_size"


def test_binary_file_source(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(jobc())
    (tmp_path / "b.bin").write_bytes(jobc()[:5])
    df = B.read_blob_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r.verdict for r in B.audit(df).collect()}
    assert got == {"a.bin": "ok", "b.bin": "short"}
