import gzip
import hashlib
import io
import tracemalloc

import pytest

from freshet.llm import common, warc
from freshet.llm.warc import Damaged, checked, digest32, member, op2_warc, parse, read_archives, record, salvage, stream, unmatched, write_archives


def archive(n=6):
    parts = [member(record("response", i, f"http://x/{i}", f"<p>{i}</p>é".encode() * 40, digest32(f"<p>{i}</p>é".encode() * 40), 1, None)) for i in range(n)]
    return parts


def ids(got):
    return [int(r.headers["WARC-Record-ID"].rstrip(">").rpartition(":")[2]) for r in got.records]


def test_whole_archive():
    parts = archive()
    got = salvage(b"".join(parts))
    assert ids(got) == list(range(6)) and got.gaps == []


def test_salvage_after_damage():
    parts = archive()
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    cut = parts[4][: len(parts[4]) // 2]
    data = parts[0] + b"junk\x1f\x8b\x08junk" + parts[1] + bytes(broken) + parts[3] + cut + parts[5][:-3]
    got = salvage(data)
    assert ids(got) == [0, 1, 3]
    covered = sorted([(r.offset, r.length) for r in got.records] + [(o, n) for o, n, _ in got.gaps])
    assert covered[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:])) and sum(covered[-1]) == len(data)


def test_salvage_uncompressed():
    r = [record("response", i, "u", b"abc%d" % i, digest32(b"abc%d" % i), 4, None) for i in range(4)]
    bad = r[1].replace(b"abc1", b"abX1")
    got = salvage(r[0] + bad + r[2] + b"WARC/1.1 no" + r[3])
    assert ids(got) == [0, 2, 3] and len(got.gaps) == 2
    assert salvage(b"").records == [] and salvage(b"nothing").gaps == [(0, 7, "no version line")]


def test_round_trip_and_roles(spark, tmp_path):
    html = ["<p>a</p>", None, "x", "<p>a</p>", "", "x", "é\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "y" * 200_000]
    rows = [(10 - i, f"u\n{i}", h) for i, h in enumerate(html)] + [(None, None, "x"), (3, "again", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", common.F.lit("k")).withColumn("first_id", common.F.lit(1)).repartition(3)
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in op2_warc(spark, pages).collect()), key=repr)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least[h or ""]
        want.append((i, len(data), digest32(data), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=repr)

    files = common.stage(spark, write_archives(pages, f"file://{tmp_path}/w", min_bytes=2), f"file://{tmp_path}/m")
    back = read_archives(files).collect()
    assert len(back) == len(rows) and all(r.gap is None for r in back)
    assert all(r.record_type == "response" for r in back if r.payload_bytes < 2)
    assert sorted(r.payload for r in back if r.record_type == "response" and r.payload_bytes > 1) == sorted([html[0], html[6], html[8]])


def test_empty_table(spark):
    assert op2_warc(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_parse_headers():
    h, block, end = parse(record("revisit", 4, "u", b"abc", digest32(b"abc"), 3, 2))
    assert h["WARC-Refers-To"].endswith(":2>") and block == b"" and h["WARC-Payload-Digest"] == "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"abc").digest()).decode()


def staged(spark, pages, root):
    manifest = common.stage(spark, write_archives(pages, f"{root}/archives"), f"{root}/manifest")
    return manifest, sum(x.records for x in manifest.collect())


def test_a_damaged_archive_fails_and_is_quarantined(spark, tmp_path):
    root = f"file://{tmp_path}"
    pages = spark.createDataFrame([(i, "u", f"<p>{i % 7}</p>" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest, n = staged(spark, pages, root)
    assert checked(spark, read_archives(manifest), n, f"{root}/a").count() == 40
    path = manifest.first().file.removeprefix("file://")
    with gzip.open(path) as f:  # one member a record, as other readers expect it
        assert f.read(8) == b"WARC/1.1"
    with open(path, "r+b") as f:
        f.seek(600)
        f.write(b"\0\0\0\0")
    with pytest.raises(Damaged, match="40 records were written"):
        checked(spark, read_archives(manifest), n, f"{root}/b")
    gap = spark.read.parquet(f"{root}/b/quarantine").collect()
    assert len(gap) == 1 and gap[0].offset <= 600 < gap[0].offset + gap[0].length
    with open(path, "wb") as f:  # whole, but one record less
        f.write(member(record("response", 1, "u", b"x", digest32(b"x"), 1, None)))
    with pytest.raises(Damaged, match="1 read"):
        checked(spark, read_archives(manifest), n, f"{root}/c")


def test_revisits_are_held_against_their_records(spark, tmp_path):
    ok, wrong = digest32(b"abc"), digest32(b"abd")
    for k, (digest, size, refers) in enumerate([(ok, 3, 1), (wrong, 3, 1), (ok, 4, 1), (ok, 3, 9)]):
        path = f"file://{tmp_path}/{k}.warc.gz"
        common.put(path, member(record("response", 1, "u", b"abc", ok, 3, None)) + member(record("revisit", 2, "u", b"", digest, size, refers)))
        read = read_archives(spark.createDataFrame([(path,)], "file string"))
        assert unmatched(read).count() == (k > 0)


def test_records_are_read_one_at_a_time(monkeypatch):
    monkeypatch.setattr(warc, "_STEP", 64)
    parts = archive(40)
    parts[7] = parts[7][:-9]
    data = b"".join(parts)
    got = list(stream(io.BytesIO(data), len(data)))
    assert [x.offset for x in got if isinstance(x, warc.Record)] == [sum(map(len, parts[:i])) for i in range(40) if i != 7]
    plain = b"".join(record("response", i, "u", b"WARC/1.1 " * 50 + b"%d" % i, digest32(b"WARC/1.1 " * 50 + b"%d" % i), 4, None) for i in range(9))
    assert [x.headers["WARC-Type"] for x in stream(io.BytesIO(b"junk" + plain), len(plain) + 4) if isinstance(x, warc.Record)] == ["response"] * 9


def test_memory_does_not_grow_with_the_archive(tmp_path):
    html = b"<p>one line of a page like many others</p>\n" * 6000  # 260 kB, 1 kB when compressed
    one = member(record("response", 1, "u", html, digest32(html), len(html), None))
    with open(tmp_path / "a", "wb") as f:
        f.write(one * 400)
    tracemalloc.start()
    with open(tmp_path / "a", "rb") as f:
        assert sum(1 for _ in stream(f, len(one) * 400)) == 400
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(html)


def test_very_long_pages(spark):
    long = "<p>" + "é word " * 600_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "")], "page_id long, url string, html string")
    got = {x.page_id: (x.payload_bytes, x.record_type, x.refers_to) for x in op2_warc(spark, pages).collect()}
    n = len(long.encode())
    assert got == {1: (n, "response", None), 2: (n, "revisit", 1), 3: (0, "response", None)}
