import hashlib
import random

import pytest

from codeweave.llm import warc

SCHEMA = "page_id long, url string, html string, digest int, key string"


def rows():
    rnd = random.Random(6)
    noise = lambda n: "".join(chr(rnd.randrange(32, 0x2000)) for _ in range(n))
    same, big = noise(1200), noise(300_000)
    out = [(1, "http://a/ b\r\nX: y", same), (2, None, same), (7, "u", same), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"),
           (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "e" * 999), (11, "u", "e" * 999), (12, "u", big), (None, "u", "n" * 2000),
           (13, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 100), (14, "u", big), (14, "u", big)]
    return [(*r, 0, "k") for r in out + [(100 + i, f"http://h/{i}", noise(rnd.randrange(3000))) for i in range(200)]]


def brute(rows):
    groups = {}
    for i, _, h, *_ in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            groups[h] = max(groups.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        first = groups.get(h) if len(data) >= 1000 else None
        revisit = first is not None and first != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def read(df, split):
    return [(r.key, r.payload_bytes, hashlib.sha1(r.payload).hexdigest() if r.payload is not None else r.digest, r.record_type, r.refers_to)
            for r in warc.read_archives(df, split).collect()]


@pytest.mark.parametrize("split", [30_000, 1 << 24])
def test_round_trip_at_any_split(spark, split):
    manifest = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows(), SCHEMA).repartition(3)))
    assert sorted(read(manifest, split), key=str) == brute(rows())
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows())


def test_ranges_own_the_records_that_start_inside(spark, tmp_path):
    parts = [warc.record(i, "u", bytes([65 + i]) * 50, hashlib.sha1(bytes([65 + i]) * 50).hexdigest(), "response") for i in range(5)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    size, starts = sum(map(len, parts)), [sum(map(len, parts[:i])) for i in range(5)]
    for split in (97, starts[1], starts[1] + 1, size):
        files = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), size)], "path string, bytes long")
        got = warc.read_archives(files, split).collect()
        assert sorted(r.offset for r in got) == starts, split
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(parts)[:-3])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark.createDataFrame([(str(tmp_path / "cut.warc.gz"), size - 3)], "path string, bytes long")).collect()


def test_empty_table(spark):
    manifest = warc.write_archives(warc.with_revisits(spark.createDataFrame([], SCHEMA)))
    assert warc.read_archives(manifest).collect() == []


def archive(tmp_path, data, name="d.warc.gz"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name), len(data)


def test_no_damage_goes_unseen(spark, tmp_path):
    """One byte flipped anywhere in a member, at any split: an error with path and offset."""
    parts = [warc.record(i, "u", bytes([65 + i]) * 90, hashlib.sha1(bytes([65 + i]) * 90).hexdigest(), "response") for i in range(10)]
    start = sum(map(len, parts[:4]))
    for k in [0, 1, 2, 3, 10, 12, 20, len(parts[4]) // 2, len(parts[4]) - 6]:
        data = bytearray(b"".join(parts))
        data[start + k] ^= 0x55
        if k == 3:    # a flag byte: other header fields follow
            data[start + k] = 0xE0
        path, size = archive(tmp_path, bytes(data), f"d{k}.warc.gz")
        for split in (size, start, start + 1, 97):
            with open(path, "rb") as f:
                seen, wrong = [], 0
                for a in range(0, size, split):
                    window = warc._Window(_File(f), a)
                    try:
                        for _, got in warc._members(window, a, min(size, a + split), path):
                            seen += [r["key"] for r in warc.records_of(got)]
                    except ValueError:
                        wrong += 1
            assert wrong or (k in (4, 5, 6, 7, 8, 9) and seen == list(range(10))), (k, split, seen)
    with pytest.raises(Exception, match=r"d0.warc.gz: no record starts at \d+"):
        warc.read_archives(spark.createDataFrame([(str(tmp_path / "d0.warc.gz"), size)], "path string, bytes long")).collect()


class _File:
    def __init__(self, f):
        self.f = f

    def read_at(self, n, at):
        self.f.seek(at)
        return self.f.read(n)


def test_several_records_in_one_member_and_bytes_between_members(spark, tmp_path):
    import zlib
    one = [warc.record(i, "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), "response") for i in range(3)]
    joined = warc._member(b"".join(zlib.decompress(m, 31) for m in one))
    got = warc.read_archives(spark.createDataFrame([archive(tmp_path, joined + one[2])], "path string, bytes long")).collect()
    assert sorted((r.key, r.payload) for r in got) == [(0, b""), (1, b"x"), (2, b"xx"), (2, b"xx")]
    with pytest.raises(Exception, match="no record starts"):
        warc.read_archives(spark.createDataFrame([archive(tmp_path, one[0] + b"junk" + one[1], "j.gz")], "path string, bytes long")).collect()
    short = warc._member(zlib.decompress(one[2], 31)[:-5])
    with pytest.raises(Exception, match="is damaged"):
        warc.read_archives(spark.createDataFrame([archive(tmp_path, short, "s.gz")], "path string, bytes long")).collect()
