"""WARC archives with a two-level capture index.

Writing: each page becomes a record, gzip-compressed on its own, in the archive of its partition. Records of equal payloads of at least LEAST_BYTES bytes are revisits of the one with the largest page_id.

Index: the captures' keys (host reversed, so that a domain's captures are neighbours, then path, then page_id) are sorted over all archives by ranges. Each range is an index file of gzip blocks of BLOCK_LINES lines; its directory has the first key of each block with offset and length. The list of ranges (first key and file, one for each range) is all that a reader holds in advance.

Lookup: binary search in the list of ranges, in that range's directory, then in the one block that is read; the entry found gives archive, offset and length of the record, which is read alone.

Files are written and read with pyarrow's file systems, below the folder that the cluster shares. A file is written under a name of its own for each attempt of a task, and only names that tasks returned are used, so a lost or repeated task leaves no doubt.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches

LEAST_BYTES = 1000
BLOCK_LINES = 256
#: zlib's level.
LEVEL = 3
#: An archive that has so many bytes is closed and a new one begun.
ARCHIVE_BYTES = 1 << 30
#: Tasks that the pages of one payload are dealt to.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"  # pages have no time of capture; a fixed one keeps archives equal between runs


def filesystem(uri: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def surt(url: str | None) -> str:
    """The URL with its host reversed: ``http://a.b.org/x`` gives ``org,b,a)/x``. Control characters and blanks are percent-encoded, so that a key stays in its line."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        rest = url or ""
    cut_at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut_at].lower(), rest[cut_at:].partition("#")[0]
    key = ",".join(reversed(host.split("."))) + ")" + (tail or "/")
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in key)


def order_key(url: str | None, page_id: int | None) -> str:
    """Key of a capture: SURT, then the identifier in fixed width, so that order by code points is order by both."""
    return f"{surt(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or revisit record; a revisit keeps the headers of the payload it does not repeat."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    safe = "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """What a record says: page_id, type, digest, refers_to, payload_bytes, and payload (None of a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    named = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    revisit = fields["WARC-Type"] == "revisit"
    return {"page_id": named(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": named(fields.get("WARC-Refers-To")), "payload_bytes": length, "payload": None if revisit else body}


def planned(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The pages with refers_to: null for responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    size, digest = F.octet_length("html"), F.sha1("html")
    # Only payloads that occur twice or more; the counting shuffles digests, partly added up before.
    twice = rows.where(size >= least).groupBy(digest.alias("same")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # The pages of one payload go to SALTS tasks; what comes to them is a narrow row for each digest that occurs twice.
    twice = twice.select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(twice, (digest == F.col("same")) & (F.pmod(F.xxhash64("page_id"), F.lit(SALTS)) == F.col("salt")) & (size >= least), "left").select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


ENTRY = "key string, archive string, offset bigint, length bigint"


def write_archives(plan: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of up to about ``most`` bytes, one or more for each partition, and returns the index entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        out, name, at = None, "", 0
        for pdf in batches:
            entries = []
            for page_id, url, html, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                number = None if pd.isna(page_id) else int(page_id)
                url = None if not isinstance(url, str) else url
                data = gzip.compress(record(number, url, payload, hashlib.sha1(payload).hexdigest(), None if pd.isna(refers_to) else int(refers_to)), LEVEL, mtime=0)
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    fs.create_dir(base, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                out.write(data)
                entries.append((order_key(url, number), name, at, len(data)))
                at += len(data)
            yield pd.DataFrame(entries, columns=["key", "archive", "offset", "length"])
        if out is not None:
            out.close()

    # Identifiers travel as text: pandas has no whole numbers beside nulls.
    return plan.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to")).mapInPandas(run, ENTRY)


class Blocks:
    """Reads a range's index: its directory and, block by block, its entries."""

    def __init__(self, fs, base: str, kept: int = 8) -> None:
        self.fs, self.base, self.kept, self.directories, self.blocks = fs, base, kept, OrderedDict(), OrderedDict()

    def directory(self, name: str) -> tuple[list[str], list[tuple[int, int]]]:
        if name not in self.directories:
            with self.fs.open_input_stream(f"{self.base}/{name}.dir", compression=None) as f:
                lines = [x.split("\t") for x in f.read().decode().splitlines()]
            self.directories[name] = [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]
            if len(self.directories) > 2:
                self.directories.popitem(last=False)
        return self.directories[name]

    def entries(self, name: str, offset: int, length: int) -> list[list[str]]:
        if (name, offset) not in self.blocks:
            with self.fs.open_input_file(f"{self.base}/{name}.cdx.gz") as f:
                raw = f.read_at(length, offset)
            self.blocks[name, offset] = [x.split("\t") for x in gzip.decompress(raw).decode().splitlines()]
            if len(self.blocks) > self.kept:
                self.blocks.popitem(last=False)
        return self.blocks[name, offset]

    def find(self, name: str, key: str) -> list[list[str]]:
        """All entries of the key (equal keys may cross into the next blocks)."""
        firsts, places = self.directory(name)
        at, out = max(0, bisect.bisect_left(firsts, key) - 1), []
        while at < len(firsts) and firsts[at] <= key:
            entries = self.entries(name, *places[at])
            i = bisect.bisect_left(entries, key, key=lambda e: e[0])
            while i < len(entries) and entries[i][0] == key:
                out.append(entries[i])
                i += 1
            at += 1
        return out


def write_index(entries: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Sorts the entries by ranges of keys and writes index file and directory for each; returns (first key, name) of each range, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        name, at, first, out, directory, waiting = uuid.uuid4().hex, 0, None, None, [], []

        def flush(lines: list[tuple]) -> None:
            nonlocal at
            data = gzip.compress("".join(f"{k}\t{a}\t{o}\t{n}\n" for k, a, o, n in lines).encode(), LEVEL, mtime=0)
            out.write(data)
            directory.append(f"{lines[0][0]}\t{at}\t{len(data)}\n")
            at += len(data)

        for pdf in batches:
            if not len(pdf):
                continue
            if out is None:
                first = pdf["key"].iloc[0]
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.cdx.gz", compression=None, buffer_size=1 << 20)
            waiting += list(zip(pdf["key"], pdf["archive"], pdf["offset"], pdf["length"], strict=True))
            while len(waiting) >= BLOCK_LINES:
                flush(waiting[:BLOCK_LINES])
                waiting = waiting[BLOCK_LINES:]
        if waiting:
            flush(waiting)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write("".join(directory).encode())
            yield pd.DataFrame({"first": [first], "name": [name]})

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = entries.repartitionByRange(n, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset").mapInPandas(run, "first string, name string")
    # A row for each range: as many as there are partitions.
    return sorted((r["first"], r["name"]) for r in ranges.collect())


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_captures(wanted: DataFrame, ranges: list[tuple[str, str]], folder: str) -> DataFrame:
    """Looks up the captures (page_id, url) in the index and reads their records; payloads are checked against their digests."""
    firsts, names = [r[0] for r in ranges], [r[1] for r in ranges]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": [order_key(u if isinstance(u, str) else None, None if pd.isna(p) else int(p)) for u, p in zip(pdf["url"], pdf["page_id"], strict=True)]})

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(*filesystem(folder))
        for pdf in batches:
            hits = []
            for key in pdf["key"].drop_duplicates():
                # Equal keys may begin in the range before the one that starts with them.
                at = max(0, bisect.bisect_left(firsts, key) - 1)
                while at < len(firsts) and firsts[at] <= key:
                    hits += [(x[1], int(x[2]), int(x[3])) for x in blocks.find(names[at], key)]
                    at += 1
            yield pd.DataFrame(hits, columns=["archive", "offset", "length"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        name, f = None, None
        for pdf in batches:
            rows = []
            for archive, offset, length in zip(pdf["archive"], pdf["offset"], pdf["length"], strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    name, f = archive, fs.open_input_file(f"{base}/{archive}")
                x = parsed(gzip.decompress(f.read_at(int(length), int(offset))))
                if x["payload"] is not None and (hashlib.sha1(x["payload"]).hexdigest(), len(x["payload"])) != (x["digest"], x["payload_bytes"]):
                    raise ValueError(f"record at {offset} of {archive} does not match its digest")
                rows.append((x["page_id"], x["payload_bytes"], x["digest"], x["type"], x["refers_to"]))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if f is not None:
            f.close()

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = wanted.select(F.col("page_id").cast("string").alias("page_id"), "url").mapInPandas(keyed, "key string").distinct()
    # Neighbouring keys share a range and its blocks; neighbouring places an archive.
    places = keys.repartitionByRange(n, "key").sortWithinPartitions("key").mapInPandas(located, "archive string, offset bigint, length bigint")
    return places.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset").mapInPandas(read, READ)


def capture(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages' records and index below ``folder`` (by default in the shared one), reads all back by the index and returns one row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url an empty target. Of equal payloads of LEAST_BYTES or more the one with the largest page_id is the response; of rows that repeat that page_id each is a response. Rows without page_id are never referred to unless all are; then each is a response. An empty table writes nothing and gives no rows. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    folder = folder or scratch(pages.sparkSession, "archives")
    pages = pages.select("page_id", "url", "html")
    entries = cut(write_archives(planned(pages), folder))
    return read_captures(pages.select("page_id", "url"), write_index(entries, folder), folder)


def unzipped(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file one by one: an archive's records without an index."""
    stream = io.BytesIO(data).getbuffer()
    while len(stream):
        z = zlib.decompressobj(wbits=31)
        yield z.decompress(stream)
        stream = stream[len(stream) - len(z.unused_data) :]
