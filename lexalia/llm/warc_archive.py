"""WARC archives with a two-level capture index.

**Writing.** Every row becomes one record, a gzip member of its own, in archive files that tasks write to
the shared folder. Rows are compared by a digest of their payload: of rows with equal payloads those with
the smallest id are *response* records, the others *revisit* records, which hold the HTTP headers but no
payload. **Index.** Captures are range-sorted by reversed-host key (``org,example)/path``). Each range is a
file of gzip blocks of sorted lines, and beside it a sparse directory with the first key, place and size
of every block. **Look-up.** Wanted urls go to the files whose key range holds them, a binary search in the
file's directory finds the block, a range read fetches it and another search the line. **Reading.** Captures
are sorted by file and place, neighbouring ones fetched by one range read, parsed, and their digests checked.

Files are named by task attempt and listed in a written table, so files of failed attempts are never
read. The shared folder must be on a file system that pyarrow opens (local or mounted, HDFS, S3, GCS).
The driver holds one row per index file; a task holds one archive record, one index block, the
directory of one index file or one range read.

Defined cases: a null payload is an empty one. Rows tied at the smallest id are all responses. A null id
comes after every other id; where all are null all are responses. A url without ``://`` is a key under an
empty host; a null url has the empty key, and is found by a null among the wanted urls. Repeated rows are
captures of their own; repeated wanted urls are one. Empty tables give no files and no rows.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lexalia.llm import rows as R
from lexalia.session import staging_path

#: An archive file ends after so many bytes, an index block after so many lines.
ARCHIVE_BYTES, BLOCK_LINES = 256 << 20, 1000
#: Captures apart by up to so many bytes are read together, up to so many at once.
GAP, READ_BYTES = 16 << 10, 4 << 20
#: Archive bytes that a reading task gets at most, about.
TASK_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """A written archive: its folder and size, the type of its ids, the tables of captures and of index files."""

    folder: str
    size: int
    id_type: str
    captures: DataFrame
    files: DataFrame


def capture_key(url: Column) -> Column:
    """Reversed-host key: host labels lower-cased and reversed, ``)``, then path and query. Null: empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(F.regexp_replace(url, "^.*?://", "\x00"), "\x00", -1))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    labels = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    key = F.when(rest.isNull(), F.concat(F.lit(")"), url)).otherwise(
        F.concat(labels, F.lit(")"), F.substring(rest, F.length(host) + 1, 2**31 - 1)))
    for mark, code in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(mark), F.lit(code))
    return F.coalesce(key, F.lit(""))


# Files ---------------------------------------------------------------------------------------------

@functools.cache
def _open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _own_name(folder: str, kind: str) -> str:
    """A path no other attempt of any task writes."""
    return f"{kind}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"


class _Writer:
    """One growing file of gzip members."""

    def __init__(self, folder: str, name: str):
        files, base = _open_folder(folder)
        self.name, self.at = name, 0
        self._out = files.open_output_stream(f"{base}/{name}", compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        """Offset and length of ``data`` as a gzip member."""
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self._out.write(member)
        place, self.at = self.at, self.at + len(member)
        return place, len(member)

    def close(self) -> None:
        self._out.close()


def _read(folder: str, name: str, offset: int = 0, length: int | None = None) -> bytes:
    files, base = _open_folder(folder)
    with files.open_input_file(f"{base}/{name}") as file:
        return file.read_at(length if length is not None else file.size(), offset)


def new_folder(df: DataFrame, label: str) -> str:
    """A new folder in the shared one, with its file system in the name."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_path(spark, label))
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for kind in ("archive", "index"):
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path, kind))
    return files.makeQualified(path).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")


# Writing -------------------------------------------------------------------------------------------

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(lines: list[tuple[str, str | None]], first: str) -> bytes:
    shown = [f"{name}: {value}" for name, value in lines if value is not None]
    return "\r\n".join([first, *shown, "", ""]).encode()


def record(url: str | None, own_id: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str = DATE) -> bytes:
    """A whole WARC record, response or revisit."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    target = None if url is None else json.dumps(url, ensure_ascii=False)[1:-1]  # no raw line ends in a header
    head = _header([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Capture-ID", own_id), ("WARC-Refers-To-Capture-ID", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], "WARC/1.1")
    return head + block + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(warc["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), payload


_CAPTURE = "_key string, _line string, file string, offset long, length long"


def _write_records(pages: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        try:
            for batch in batches:
                lines, places = [], []
                columns = [batch.column(c) for c in ("_url", "_id", "_first", "_revisit", "_payload")]
                for row in zip(*columns):
                    url, own, first, revisit, payload = (v.as_py() for v in row)
                    if out is None or out.at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        out = _Writer(folder, _own_name(folder, "archive") + ".warc.gz")
                    at, size = out.add(record(url, own, payload or b"", first, revisit))
                    places.append((out.name, at, size))
                    lines.append(json.dumps({"url": url, "file": out.name, "offset": at, "length": size}, ensure_ascii=False))
                names, offsets, sizes = zip(*places) if places else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key"), pa.array(lines, pa.string()), pa.array(names, pa.string()),
                     pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())],
                    ["_key", "_line", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return pages.mapInArrow(run, _CAPTURE)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Archives of all rows and their index; ``captures`` says where each record lies (``file, offset, length``)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = R.bounded(pages).select(
        F.col(id_col).alias("_own"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"),
        F.unhex(F.sha2(payload, 256)).alias("_digest"))
    # Digests alone are counted; only those of several rows are joined back.
    several = R.stage(rows.groupBy("_digest").agg(F.count("*").alias("_n"), F.min("_own").alias("_least"))
                      .where("_n > 1").select("_digest", "_least"), "copies")
    joined = rows.join(several.withColumn("_copy", F.lit(True)), "_digest", "left").select(
        capture_key(F.col("_url")).alias("_key"), "_url", F.col("_own").cast("string").alias("_id"),
        F.col("_least").cast("string").alias("_first"),
        (F.coalesce("_copy", F.lit(False)) & ~F.col("_own").eqNullSafe(F.col("_least"))).alias("_revisit"), "_payload")
    folder = new_folder(pages, "warc")
    captures = R.stage(_write_records(joined, folder), "captures")
    size = captures.agg(F.sum("length")).first()[0] or 0
    return Archive(folder, size, rows.schema["_own"].dataType.simpleString(), captures, R.stage(_write_index(captures, folder), "index-files"))


# Index ---------------------------------------------------------------------------------------------

def _write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Blocks of sorted lines in one file per key range; one row per file."""
    order = ["_key", "file", "offset"]
    ranges = captures.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting, directory, last = None, [], [], ""

        def block() -> None:
            place = out.add("".join(f"{k}\t{line}\n" for k, line in waiting).encode())
            directory.append((waiting[0][0], *place, len(waiting)))
            waiting.clear()

        for batch in batches:
            for key, line in zip(batch.column("_key").to_pylist(), batch.column("_line").to_pylist()):
                if out is None:
                    out = _Writer(folder, _own_name(folder, "index") + ".cdx.gz")
                waiting.append((key, line))
                last = key
                if len(waiting) >= BLOCK_LINES:
                    block()
        if out is not None:
            if waiting:
                block()
            out.close()
            beside = _Writer(folder, out.name + ".directory")
            beside.add("".join(f"{k}\t{a}\t{b}\t{n}\n" for k, a, b, n in directory).encode())
            beside.close()
            yield pa.RecordBatch.from_pylist([{
                "file": out.name, "first_key": directory[0][0], "last_key": last, "blocks": len(directory),
                "captures": sum(d[3] for d in directory)}])

    return ranges.select("_key", "_line").mapInArrow(
        run, "file string, first_key string, last_key string, blocks long, captures long")


class IndexFile:
    """One range of the index: its directory in memory, its blocks read when wanted."""

    def __init__(self, folder: str, name: str):
        lines = zlib.decompress(_read(folder, name + ".directory"), 31).decode().split("\n")[:-1]
        self._folder, self._name = folder, name
        self._blocks = [(key, int(at), int(size)) for key, at, size, _ in (line.split("\t") for line in lines)]
        self._keys = [key.encode() for key, _, _ in self._blocks]
        self._held: tuple[int, list] = (-1, [])

    def _lines(self, block: int) -> list[tuple[bytes, str]]:
        if self._held[0] != block:
            _, at, size = self._blocks[block]
            text = zlib.decompress(_read(self._folder, self._name, at, size), 31).decode()
            lines = (line.split("\t", 1) for line in text.split("\n")[:-1])
            self._held = block, [(key.encode(), value) for key, value in lines]
        return self._held[1]

    def find(self, key: str) -> Iterator[dict]:
        """Captures of ``key``, which may run over several blocks."""
        wanted = key.encode()
        block = max(bisect.bisect_left(self._keys, wanted) - 1, 0)
        while block < len(self._blocks) and self._keys[block] <= wanted:
            lines = self._lines(block)
            for i in range(bisect.bisect_left(lines, (wanted,)), len(lines)):
                if lines[i][0] != wanted:
                    return
                yield json.loads(lines[i][1])
            block += 1


def look_up(archive: Archive, urls: DataFrame) -> DataFrame:
    """``file, offset, length`` of every capture of the wanted urls (first column of ``urls``)."""
    folder = archive.folder
    # One row per range of the sort: as many as the shuffle has partitions.
    ranges = sorted((r["first_key"].encode(), r["last_key"].encode(), r["file"]) for r in archive.files.collect())
    first, last = [r[0] for r in ranges], [r[1] for r in ranges]
    url = F.col(urls.columns[0]).cast("string")
    wanted = urls.select(url.alias("_url")).distinct().select(capture_key(F.col("_url")).alias("_key"), "_url")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, files = [], []
            for i, key in enumerate(batch.column("_key").to_pylist()):
                key = key.encode()
                for f in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                    at.append(i)
                    files.append(f)
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), *own.columns], ["_file", "_key", "_url"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            found = []
            for f, key, url in zip(*[batch.column(c).to_pylist() for c in ("_file", "_key", "_url")]):
                if f != now:
                    now, index = f, IndexFile(folder, ranges[f][2])
                for line in index.find(key):
                    if line["url"] == url:
                        found.append((line["file"], line["offset"], line["length"]))
                    if len(found) >= 1 << 16:
                        yield _captures(found)
                        found = []
            yield _captures(found)

    routed = wanted.mapInArrow(route, "_file int, _key string, _url string")
    return routed.repartition("_file").sortWithinPartitions("_file", "_key").mapInArrow(
        search, "file string, offset long, length long")


def _captures(found: list[tuple[str, int, int]]) -> pa.RecordBatch:
    file, offset, length = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
        ["file", "offset", "length"])


# Reading -------------------------------------------------------------------------------------------

def _members(folder: str, rows: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
    """Bytes of captures sorted by file and offset, by few range reads."""
    def whole(group: list[tuple[str, int, int]]) -> Iterator[bytes]:
        low = group[0][1]
        data = _read(folder, group[0][0], low, max(o + n for _, o, n in group) - low)
        for _, offset, length in group:
            yield data[offset - low:offset - low + length]

    group: list[tuple[str, int, int]] = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] - (group[-1][1] + group[-1][2]) > GAP
                      or row[1] + row[2] - group[0][1] > READ_BYTES):
            yield from whole(group)
            group = []
        group.append(row)
    if group:
        yield from whole(group)


def fetch(archive: Archive, captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ``captures`` (``file, offset, length``), read from the archives and checked.

    ``id, url, record_type, refers_to, payload_bytes, payload_digest`` and, ``with_payload``, the payload
    as bytes (null for revisits). A response whose payload does not have its digest raises an error.
    """
    folder = archive.folder
    kind = archive.id_type
    part = F.floor(F.col("offset") / F.lit(8 << 20))
    # By the size of the records: the rows that name them are too small for Spark to judge the work by.
    tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), archive.size // TASK_BYTES)
    dealt = captures.select("file", "offset", "length").repartition(tasks, "file", part).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")])

        out, held = [], 0
        for member in _members(folder, places()):
            warc, http, payload = parse(member)
            revisit = warc["WARC-Type"] == "revisit"
            digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
            if not revisit and base32_sha1(payload) != digest:
                raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
            url = warc.get("WARC-Target-URI")
            out.append((warc.get("WARC-Capture-ID"), None if url is None else json.loads(f'"{url}"'), warc["WARC-Type"],
                        warc.get("WARC-Refers-To-Capture-ID"), int(http["Content-Length"]), digest,
                        payload if with_payload and not revisit else None))
            held += len(payload) if with_payload else 100
            if held >= READ_BYTES:
                yield _records(out)
                out, held = [], 0
        yield _records(out)

    rows = dealt.mapInArrow(run, "id string, url string, record_type string, refers_to string, "
                                 "payload_bytes long, payload_digest string, payload binary")
    found = rows.withColumns({c: F.col(c).cast(kind) for c in ("id", "refers_to")})
    return found if with_payload else found.drop("payload")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [
        "id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
