"""WARC archives: writing, normalising whole-file gzip streams, indexed reading.

A crawler that compresses a whole archive as one gzip stream leaves a file in which no record can be
found without inflating all before it. ``normalise`` inflates such a stream once, from its start to
its end, writes every record as a gzip member of its own, and beside each archive a sidecar with one
line for each record: offset, length, type, ids, digest. ``read`` then fetches any record by itself, so that
one archive's records are dealt over many tasks.

Of records with equal payloads the one with the largest id is a response, the others revisit it
without a payload. Copies are found by digests alone (map-side maximum, 48 bytes a group). Groups few
enough are broadcast; otherwise the rows of the largest, at most HOT_SHARES for each partition, are
marked by a broadcast and only the others are joined, so no digest's rows meet in one task.

Files are opened by URI through ``pyarrow.fs``, so the folder can lie in any store that it knows; it
must be one that all executors share. A task's archive counts only if the task was committed: names
are unique for each attempt and the table of names is written by Spark. The normaliser's output is
the same for each attempt and is moved to its place when complete.

Edge cases: a null payload is empty; a null id counts as the smallest, and its record has no id; a null
url has no target; of rows equal in id and payload all that hold the largest id are responses; white
space and control characters of a url are percent-encoded in the archive; an empty table gives an
empty result; a stream cut short or damaged keeps its whole records and is reported as damaged.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import drop_stage, scratch, shuffle_width, stage

REVISIT_FROM = 0  # bytes of payload from which equal ones are revisited
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
CHUNK = 1 << 20
MOST_BROADCAST = 100_000  # groups of equal payloads, some 100 bytes each
HOT_SHARES = 8

INDEX = "file string, offset long, length long, type string, record_id string, target string, digest string"


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _into(uri: str, name: str):
    """File system, place and unfinished place of a new file."""
    fs, folder = _open(uri)
    fs.create_dir(folder, recursive=True)
    return fs, f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"


def record_id(key: str | None) -> str:
    return "<urn:page>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def page_key(value: str) -> str | None:
    return unquote(value[len("<urn:page:") : -1]) if value.startswith("<urn:page:") else None


def _header(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record(key: str | None, url: str | None, body: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record with the separator after it. A revisit (``refers_to`` given) holds the reply's header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def base32_sha1(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def marked(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``key``, ``url``, ``body`` and, for all but one of equal payloads, ``refers_to``; a staged table of the groups stands behind it."""
    body = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), body.alias("body"), F.unhex(F.sha1(body)).alias("digest"))
    narrow = rows.where(F.octet_length("body") >= revisit_from).groupBy("digest").agg(F.max("key").alias("original"), F.count("*").alias("n"))
    copies, _ = stage(narrow.where("n > 1 and original is not null"), "warc-copies")
    groups, copied = copies.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if groups <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(copies.drop("n")), "digest", "left")
    else:
        hot = F.col("n") * HOT_SHARES * shuffle_width(pages.sparkSession) > copied
        most, few = copies.where(hot).drop("n"), copies.where(~hot).drop("n")
        joined = rows.join(F.broadcast(most), "digest").unionByName(rows.join(F.broadcast(most), "digest", "left_anti").join(few.hint("merge"), "digest", "left"))
    smaller = F.col("key").isNull() | (F.col("key") < F.col("original"))
    refers = F.when(F.col("original").isNotNull() & smaller, F.col("original"))
    return joined.select(F.col("key").cast("string").alias("key"), "url", "body", refers.cast("string").alias("refers_to"))


def write_streams(rows: DataFrame, folder: str, level: int = 1) -> tuple[DataFrame, str]:
    """Writes the rows of each task as one archive in one gzip stream; returns a staged table of ``file`` and ``records``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sink, records, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for key, url, body, refers_to in zip(batch["key"], batch["url"], batch["body"], batch["refers_to"]):
                if sink is None:
                    fs, place, _ = _into(folder, name)
                    sink, press = fs.open_output_stream(place, compression=None), zlib.compressobj(level, wbits=31)
                    about = b"software: bidweave\r\nformat: WARC File Format 1.1\r\n"
                    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]
                    sink.write(press.compress(_header(fields) + about + b"\r\n\r\n"))
                sink.write(press.compress(record(key, url, body, base32_sha1(body), refers_to)))
                records += 1
        if sink is not None:
            sink.write(press.flush())
            sink.close()
            yield pd.DataFrame({"file": [f"{folder}/{name}"], "records": [records]})

    return stage(rows.mapInPandas(run, "file string, records long"), "warc-names")


def _fields(source: io.BufferedIOBase) -> tuple[bytes, dict[str, str]] | None:
    """The next header as it stands, and its fields under lower-case names; nothing at the end. A folded
    line belongs to the one before."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no record where one should begin")
    lines, out, last = [line], {}, ""
    while (line := source.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise EOFError
        lines.append(line)
        text = line.decode(errors="replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            out[last] = f"{out[last]} {text.strip()}".strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return b"".join([*lines, line]), out


def members(source: io.BufferedIOBase, level: int = LEVEL) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every whole record of an inflated stream: its fields, and its bytes as a gzip member."""
    while (header := _fields(source)) is not None:
        press = zlib.compressobj(level, wbits=31)
        out, left = [press.compress(header[0])], int(header[1]["content-length"])
        while left:
            part = source.read(min(left, CHUNK))
            if not part:
                raise EOFError
            out.append(press.compress(part))
            left -= len(part)
        out.append(press.compress(b"\r\n\r\n") + press.flush())
        yield header[1], b"".join(out)


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> tuple[DataFrame, str]:
    """Rewrites each ``file`` into ``folder``, record by record, with its sidecar; returns a staged table of
    ``file`` (the new one), ``records`` and ``damaged``."""

    def one(uri: str) -> tuple[str, int, bool]:
        fs, place = _open(uri)
        name = re.sub(r"(\.warc)?(\.gz)?$", "", place.rsplit("/", 1)[-1])
        target, archive, unfinished = _into(folder, f"{name}.warc.gz")
        _, sidecar, listed = _into(folder, f"{name}.json")
        records, offset, damaged = 0, 0, False
        with fs.open_input_stream(place, compression=None) as raw, target.open_output_stream(unfinished, compression=None) as sink, target.open_output_stream(listed, compression=None) as side:
            try:
                for fields, member in members(gzip.GzipFile(fileobj=raw), level):
                    line = {
                        "file": f"{folder}/{name}.warc.gz", "offset": offset, "length": len(member), "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
                        "target": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"),
                    }
                    side.write(json.dumps(line).encode() + b"\n")
                    sink.write(member)
                    offset += len(member)
                    records += 1
            except (EOFError, gzip.BadGzipFile, zlib.error, ValueError, KeyError):
                damaged = True
        target.move(unfinished, archive)
        target.move(listed, sidecar)
        return f"{folder}/{name}.warc.gz", records, damaged

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["file"]:
                yield pd.DataFrame([one(uri)], columns=["file", "records", "damaged"])

    store, place = _open(folder)
    store.create_dir(place, recursive=True)  # there is one even if no file is
    dealt = files.select("file").repartitionByRange(max(1, files.count()), "file")
    return stage(dealt.mapInPandas(run, "file string, records long, damaged boolean"), "warc-normalised")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of a folder's sidecars."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.json").json(folder)


def read(lines: DataFrame) -> DataFrame:
    """Each response and revisit of an index, fetched by its offset: ``key``, ``url``, ``type``, ``refers_to``
    (of the page), ``payload_bytes``, ``payload_digest`` (of the full payload) and ``body`` (of responses)."""

    def parse(raw: bytes) -> dict:
        source = io.BytesIO(zlib.decompress(raw, wbits=31))
        _, fields = _fields(source)
        block = source.read(int(fields["content-length"]))
        head, _, body = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
        named = fields["warc-payload-digest"].removeprefix("sha1:")
        reply = fields["warc-type"] == "response"
        if reply and (len(body) != size or base32_sha1(body) != named):
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
        refers = fields.get("warc-refers-to")
        return {
            "key": page_key(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "type": fields["warc-type"], "refers_to": refers and page_key(refers),
            "payload_bytes": size, "payload_digest": named, "body": body if reply else None,
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, part in batch.groupby("file", sort=False):
                fs, place = _open(uri)
                with fs.open_input_file(place) as source:
                    for at in range(0, len(part), 500):
                        rows = part.iloc[at : at + 500]
                        yield pd.DataFrame([parse(source.read_at(n, start)) for start, n in zip(rows["offset"].tolist(), rows["length"].tolist())])

    wanted = lines.where("type in ('response', 'revisit')").select("file", "offset", "length")
    dealt = wanted.repartitionByRange(shuffle_width(lines.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(run, "key string, url string, type string, refers_to string, payload_bytes long, payload_digest string, body binary")


def archive(pages: DataFrame, folder: str, html: str = "html", key: str = "page_id", url: str = "url", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Writes all pages to whole-file streams, normalises these into ``folder``/archives and deletes
    them; returns the table of ``normalise``."""
    with scratch(pages.sparkSession) as keep:
        names, _ = write_streams(marked(pages, html, key, url, revisit_from), f"{folder}/streams")
        done = keep(normalise(names, f"{folder}/archives"))
        drop_stage(pages.sparkSession, f"{folder}/streams")
    return done
