"""Archives: what is written comes back, byte for byte, in bounded chunks."""

import glob
import gzip
import hashlib
import re

import pytest

from storepulse.llm import warc

PAGES = [
    (1, "http://a/", "x" * 99), (2, "http://b/", "x" * 99), (3, "http://c/\r\nWARC-Type: forged", "y" * 100),
    (9, "http://d/", "y" * 100), (4, "http://e/", "y" * 100), (5, None, None), (6, "u", ""),
    (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30), (8, "u", "\r\n\r\n" * 400), (10, "u", "\n"),
    (11, "u", "é漢🙂" * 20_000), (12, "u", "line\n" * 50_000 + "end"), (13, "u", "z" * 300_000 + "\n\n"),
    (14, "u", "é漢🙂" * 20_000), (None, "u", "no id" * 50), (None, "u", "no id" * 50), (15, "u", "\r"), (16, "u", "tail\r\n"),
    (20, "u", "twin" * 40), (20, "u", "twin" * 40), (21, "u", "twin" * 40),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "q") for i, u, h in PAGES], "page_id long, url string, html string, URL2 string").repartition(3)


def expected():
    out = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        same = [j for j, _, other in PAGES if (other or "") == (h or "") and j is not None]
        first = min(same, default=None) if len(body) >= 100 else None
        revisit = first is not None and first != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 1000])
def test_round_trip(spark, pages, chunk):
    got = warc.archived_pages(spark, pages, warc.WarcOptions(chunk_bytes=chunk))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected()


def test_chunks_join_to_the_payload(spark, pages, tmp_path):
    path = warc.write_warc(pages, str(tmp_path / "w"), "page_id", "url", "html")
    rows = warc.read_warc(spark, path, warc.WarcOptions(chunk_bytes=777)).collect()
    bodies = {}
    for r in sorted(rows, key=lambda r: (r.file, r.record_no, r.chunk_no)):
        key = (r.file, r.record_no)
        assert len(r.chunk) <= 777 and r.chunk_start == len(bodies.get(key, b""))
        bodies[key] = bodies.get(key, b"") + bytes(r.chunk)
        assert r.digest_so_far == hashlib.sha256(bodies[key]).hexdigest()
        if r.is_last and r.record_type == "response":
            assert r.stated_digest == r.digest_so_far and r.stated_bytes == len(bodies[key])
    assert len(bodies) == len(PAGES)


def test_files_are_valid_warc(spark, pages, tmp_path):
    """A plain reader that trusts Content-Length only."""
    path = warc.write_warc(pages, str(tmp_path / "w"), "page_id", "url", "html")
    types = []
    for name in glob.glob(path + "/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            types.append(fields["WARC-Type"])
            data = rest[size + 4:]
    assert sorted(types) == sorted(t for *_, t, _ in expected())


def test_every_record_has_a_date_and_ids_differ(spark, pages, tmp_path):
    path = warc.write_warc(pages, str(tmp_path / "w"), "page_id", "url", "html")
    text = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.gz"))
    dates = re.findall(rb"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", text)
    assert len(dates) == len(PAGES)
    ids = {(r.record_id, r.stated_digest) for r in warc.read_warc(spark, path).filter("is_last").collect()}
    assert len({i for i, _ in ids}) == len(set((p, h or "") for p, _, h in PAGES))
    # What a revisit names is the record of a response.
    got = warc.read_warc(spark, path).filter("is_last").collect()
    responses = {r.record_id for r in got if r.record_type == "response"}
    assert all(r.refers_to in responses for r in got if r.record_type == "revisit")


def test_only_copies_are_moved(spark, tmp_path):
    """Rows without a copy go from the scan to the writer without a shuffle."""
    spark.createDataFrame([(i, f"u{i}", f"{i} " * 80) for i in range(50)] + [(99, "u", "1 " * 80)], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    plan = warc.plan_records(spark.read.parquet(str(tmp_path / "p")), "page_id", "url", "html")
    alone = plan._jdf.queryExecution().optimizedPlan().toString()
    union = alone.index("Union")
    assert "Join" not in alone[union:alone.index("Join")] and alone.count("Join") == 1
    assert sorted(r["first"] for r in plan.filter("first is not null").collect()) == [1]


def test_damaged_archives_are_reported():
    reader = warc.ChunkReader(10)
    with pytest.raises(ValueError, match="no WARC record"):
        reader.line("f", b"not a record")
    reader = warc.ChunkReader(10)
    for line in (b"WARC/1.1\r", b"Content-Length: 50\r", b"\r", b"too short"):
        reader.line("f", line)
    with pytest.raises(ValueError, match="cut off"):
        reader._ended()


def test_empty_table(spark, pages):
    assert warc.archived_pages(spark, pages.limit(0)).count() == 0
