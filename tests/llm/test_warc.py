"""Archives: what is read back, the files themselves, and lost attempts."""

import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest

from checks.compare import connect
from skyledger.llm import warc
from skyledger.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, file string, `a.b` int"
FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def expected(rows, least=0):
    groups = defaultdict(list)
    for page, url, html in rows:
        groups[(html or "").encode()].append((page is not None, page or 0, url is not None, url or ""))
    out = []
    for payload, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i, (known, page, _, _) in enumerate(sorted(members, reverse=True)):
            revisit = i > 0 and len(payload) >= least
            first = max(members)
            to = first[1] if revisit and first[0] else None
            kind = "revisit" if revisit else "response"
            out.append((page if known else None, len(payload), digest, kind, to))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*FIELDS).collect()), key=repr)


def rows():
    made = [(i, f"http://host/{i}?q=a b\n{i}", f"<p>página {i % 40}</p>" * (i % 9)) for i in range(200)]
    made += [
        (None, None, None), (None, None, None), (None, "http://x", ""), (5000, None, "x" * 3_000_000),
        (5001, "http://é/", "x" * 3_000_000), (7, "http://host/7", "\r\n\r\nWARC/1.1\r\n\r\n"),
        (8, "u", "only"), (8, "u", "only"), (8, "v", "only"), (None, "u", "only"),
        (None, "u", "lone"), (None, "u", "lone"),
    ]
    return made


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA).repartition(3)


@pytest.mark.parametrize("least", [0, 30])
def test_read_back(spark, tmp_path, least):
    path = str(tmp_path / "archive")
    manifest = warc.write_warc(frame(spark, rows()), path, least=least, roll=2000)
    assert got(warc.read_warc(manifest, path)) == expected(rows(), least)


def test_files_are_warc(spark, tmp_path):
    path = tmp_path / "archive"
    manifest = warc.write_warc(frame(spark, rows()), f"file://{path}", roll=2000).collect()
    files = sorted(path.glob("*.warc.gz"))
    assert [f.name for f in files] == sorted(r.file for r in manifest) and len(files) > 4
    assert not list((path / "_temporary").iterdir())
    names, targets = {}, set()
    for f in files:
        row = next(r for r in manifest if r.file == f.name)
        assert f.stat().st_size == row.bytes
        assert hashlib.sha1(f.read_bytes()).hexdigest() == row.sha1
        data, n = gzip.decompress(f.read_bytes()), -1
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            size = int(fields["Content-Length"])
            block, end, data = data[:size], data[size : size + 4], data[size + 4 :]
            assert version == "WARC/1.1" and end == b"\r\n\r\n"
            assert fields["WARC-Record-ID"] not in names
            names[fields["WARC-Record-ID"]] = fields
            targets.add(fields.get("WARC-Refers-To"))
            n += 1
            if fields["WARC-Type"] != "warcinfo":
                digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                assert fields["WARC-Block-Digest"] == f"sha1:{digest}"
                payload = block.split(b"\r\n\r\n", 1)[1]
                assert bool(payload) <= (fields["WARC-Type"] == "response")
        assert n == row.records
    assert {names[t]["WARC-Type"] for t in targets if t} == {"response"}


def test_order_and_same_bytes_again(spark, tmp_path):
    df = frame(spark, rows())
    held = []
    for name in ("a", "b"):
        warc.write_warc(df, str(tmp_path / name), roll=2000)
        files = sorted((tmp_path / name).glob("*.warc.gz"))
        held.append([(f.name, f.read_bytes()) for f in files])
    assert held[0] == held[1]
    ids = [
        int(line.split(b": ")[1])
        for _, data in held[0]
        for line in gzip.decompress(data).split(b"\r\n")
        if line.startswith(b"X-Id: ")
    ]
    assert ids == sorted(ids)


def test_lost_attempts_and_commit_again(spark, tmp_path):
    path = tmp_path / "archive"
    manifest = warc.write_warc(frame(spark, rows()), str(path), roll=2000)
    name = manifest.first().file
    (path / "_temporary" / f"{name}.0badattempt").write_bytes(b"half a rec")
    (path / name).rename(path / manifest.first().temporary)  # as if it stopped before this one
    warc.commit(manifest, str(path))
    warc.commit(manifest, str(path))
    assert got(warc.read_warc(manifest, str(path))) == expected(rows())


@pytest.mark.parametrize("harm", ["flip", "cut"])
def test_harm_is_seen(spark, tmp_path, harm):
    path = tmp_path / "archive"
    manifest = warc.write_warc(frame(spark, [(1, "u", "<p>text</p>")]), str(path))
    file = Path(path, manifest.first().file)
    data = gzip.decompress(file.read_bytes())
    data = data.replace(b"<p>text", b"<p>test") if harm == "flip" else data[:-30]
    at = data.index(b"WARC/1.1\r\nWARC-Type: response")
    file.write_bytes(gzip.compress(data[:at]) + gzip.compress(data[at:]))
    with pytest.raises(Exception, match="wrong WARC|before its length"):
        warc.read_warc(manifest, str(path)).collect()


def test_empty_table(spark, tmp_path):
    manifest = warc.write_warc(frame(spark, []), str(tmp_path / "none"))
    assert manifest.count() == 0
    assert warc.read_warc(manifest, str(tmp_path / "none")).count() == 0


def test_query_on_the_whole_table(spark, sf):
    data = connect(sf).execute("SELECT page_id, url, html FROM pages").fetchall()
    assert got(QUERIES["op13_warc"](spark, sf)) == expected(data)
