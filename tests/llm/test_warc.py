import base64
import gzip
import hashlib
import json
import os
import zlib

import pytest

from bidweave.llm import warc
from bidweave.llm.queries import op11_warc

SCHEMA = "page_id long, url string, html string, key string, body string, digest string, file string, offset string"


def plain(rows, least=0):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        ids = [x for x in groups[body] if x is not None]
        top = max(ids, default=None)
        revisit = len(body) >= least and top is not None and i != top
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def read_back(table, folder, **more):
    done = warc.archive(table, folder, **more).collect()
    found = warc.read(warc.index(table.sparkSession, f"{folder}/archives")).collect()
    return done, found


def shape(found):
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r["key"]), r["payload_bytes"], r["payload_digest"], r["type"], number(r["refers_to"])) for r in found), key=str)


def test_query_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in op11_warc(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == plain([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def awkward_pages(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (9, "http://b\r\nWARC-Type: bad\r\n\r\n", "same"), (3, "", None), (4, "u", ""), (None, "n", "same"), (None, "n", "alone"), (None, "n", "alone")]
    rows += [(5, "x y\té", "é漢😀"), (9, "http://b", "same"), (6, "w", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (7, "w", "\r\n\r\n"), (8, "big", "<p>" + "x" * 3_000_000)]
    rows += [(i, f"http://c/{i}", "copy") for i in range(100, 400)]
    return rows, spark.createDataFrame([(*r, None, "b", "d", "f", "o") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("least,most", [(0, 100_000), (4, 0), (5, 1)])
def test_awkward_pages(spark, tmp_path, monkeypatch, least, most):
    monkeypatch.setattr(warc, "MOST_BROADCAST", most)
    rows, table = awkward_pages(spark)
    done, found = read_back(table, f"file://{tmp_path}", revisit_from=least)
    assert shape(found) == plain(rows, least)
    assert not any(r["damaged"] for r in done) and not os.path.exists(tmp_path / "streams")
    bodies = {r["key"]: bytes(r["body"]) for r in found if r["type"] == "response"}
    assert bodies["8"] == b"<p>" + b"x" * 3_000_000 and bodies["5"] == "é漢😀".encode()
    assert {r["url"] for r in found if r["key"] == "5"} == {"x%20y%09é"}


def test_empty_table(spark, tmp_path):
    done, found = read_back(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}")
    assert done == [] and found == []


def test_members_and_offsets(spark, tmp_path):
    """Every record is a member of its own at the place that the sidecar names, and they make up the whole file."""
    rows, table = awkward_pages(spark)
    done, _ = read_back(table, f"file://{tmp_path}")
    for r in done:
        name = r["file"].removeprefix("file://")
        raw, at = open(name, "rb").read(), 0
        lines = [json.loads(x) for x in open(name.replace(".warc.gz", ".json"))]
        assert len(lines) == r["records"] and lines[0]["type"] == "warcinfo"
        for line in lines:
            assert line["offset"] == at
            inflate = zlib.decompressobj(wbits=31)
            text = inflate.decompress(raw[at : at + line["length"]])
            assert inflate.eof and not inflate.unused_data and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            at += line["length"]
        assert at == len(raw)


def files(spark, tmp_path, contents):
    os.makedirs(tmp_path / "in")
    for name, raw in contents.items():
        (tmp_path / "in" / name).write_bytes(raw)
    return spark.createDataFrame([(f"file://{tmp_path}/in/{n}",) for n in contents], "file string")


def test_streams_of_other_writers(spark, tmp_path):
    """Streams of several members, folded headers, bare line ends, cut and damaged streams."""
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    digest = base64.b32encode(hashlib.sha1(b"hi").digest())

    def one(key, end=b"\r\n"):
        head = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID:", b"\t<urn:page:%d>" % key, b"warc-payload-DIGEST: sha1:" + digest, b"Content-Length: %d" % len(body), b"", b""]
        return end.join(head) + body + b"\r\n\r\n"

    noise = os.urandom(4000).hex().encode()
    long = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: %d\r\n\r\n" % len(noise) + noise + b"\r\n\r\n"
    contents = {
        "whole.warc.gz": gzip.compress(one(1) + one(2)), "members.warc.gz": gzip.compress(one(3)) + gzip.compress(one(4)[:30]) + gzip.compress(one(4)[30:]), "bare.warc.gz": gzip.compress(one(5, b"\n")),
        "cut.warc.gz": gzip.compress(one(6) + long)[:-900], "tail.warc.gz": gzip.compress(one(7)) + b"no member", "text.warc.gz": b"not compressed", "empty.warc.gz": b"", "lost.warc.gz": gzip.compress(one(8) + b"something else\r\n"),
    }
    done, _ = warc.normalise(files(spark, tmp_path, contents), f"file://{tmp_path}/out")
    state = {r["file"].rsplit("/", 1)[-1].split(".")[0]: (r["records"], r["damaged"]) for r in done.collect()}
    assert state == {"whole": (2, False), "members": (2, False), "bare": (1, False), "cut": (1, True), "tail": (1, True), "text": (0, True), "empty": (0, False), "lost": (1, True)}
    found = warc.read(warc.index(spark, f"file://{tmp_path}/out")).collect()
    assert sorted(r["key"] for r in found) == ["1", "2", "3", "4", "5", "6", "7", "8"] and {bytes(r["body"]) for r in found} == {b"hi"}


def test_wrong_digest_is_not_read(spark, tmp_path):
    rows = spark.createDataFrame([("1", "u", b"abc", None)], "key string, url string, body binary, refers_to string")
    names, _ = warc.write_streams(rows, f"file://{tmp_path}/s")
    path = names.first()["file"].removeprefix("file://")
    raw = gzip.decompress(open(path, "rb").read()).replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    open(path, "wb").write(gzip.compress(raw))
    warc.normalise(names, f"file://{tmp_path}/a")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read(warc.index(spark, f"file://{tmp_path}/a")).collect()
