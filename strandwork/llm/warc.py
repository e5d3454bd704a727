"""WARC archives: writing, the normaliser for monolithic gzip files, and reading back.

``write`` makes one archive per task, each a single gzip stream over many records, as careless writers leave them.
``normalise`` inflates each such file once, front to back in bounded memory, rewrites every record as a gzip member
of its own, and writes a sidecar index (record id, offset, length of each member). ``read`` follows the index.

Files lie in a folder that driver and executors share, opened through ``pyarrow.fs`` by its URI. Each attempt of a task
writes under names of its own and returns them, so what a lost attempt left behind is never read, and nothing is
renamed.

Edge cases: null payloads count as empty; of rows with equal payloads all those with the smallest id (null ids come
last) are responses, so repeated rows stay alike; an empty table makes an empty result; memory is bounded by one record
and one buffer.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import arrow_map

CHUNK = 1 << 20
RESPONSE, REVISIT = "response", "revisit"


def open_fs(uri: str):
    """File system and path of a shared folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response(row: int, page_id, url: str | None, payload: bytes, sha: str, kind: str, refers_to) -> bytes:
    """A response with its payload, or a revisit that refers to the record that has it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}')}>", "WARC-Target-URI": "".join((url or "about:blank").split()), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{sha}", "X-Row": str(row), "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if kind == REVISIT:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        if refers_to is not None:
            headers |= {"X-Refers-To": str(refers_to)}
        return record(headers, http + b"\r\n")
    return record(headers, http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)


class Records:
    """Cuts an inflated stream into records; ``feed`` gives those that are whole."""

    def __init__(self):
        self.rest = bytearray()

    def feed(self, data: bytes):
        self.rest += data
        while (record_ := self._next()) is not None:
            yield record_

    def _next(self) -> bytes | None:
        stop = self.rest.find(b"\r\n\r\n")
        if stop < 0:
            return None
        length = next(int(x.split(b":", 1)[1]) for x in self.rest[:stop].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        end = stop + 4 + length + 4
        if len(self.rest) < end:
            return None
        found = bytes(self.rest[:end])
        del self.rest[:end]
        return found


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, block[: int(headers["Content-Length"])]


def inflate(stream, size: int = CHUNK):
    """The content of a gzip file, one member or many, in pieces."""
    engine = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
    yield engine.flush()


def member(raw: bytes) -> bytes:
    engine = zlib.compressobj(1, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def normalise_file(files, source: str, target: str, index: str) -> int:
    """Rewrite one archive with a member per record, and its index; how many records it has."""
    offset, cutter, n = 0, Records(), 0
    with files.open_input_stream(source, compression=None) as inp, files.open_output_stream(target, compression=None) as out, files.open_output_stream(index, compression=None) as side:
        for data in inflate(inp):
            for raw in cutter.feed(data):
                part = member(raw)
                out.write(part)
                side.write((json.dumps({"id": parse(raw)[0]["WARC-Record-ID"], "offset": offset, "length": len(part)}) + "\n").encode())
                offset += len(part)
                n += 1
    if cutter.rest:
        raise ValueError(f"{source} ends within a record")
    return n


def plan(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """``id, url, payload, again, refers_to``: what to write for each row.

    Payloads are told apart by their SHA-1; only digests and ids are grouped, and a digest that many rows share is
    reduced before the shuffle. Nothing depends on how rows are dealt or how often the plan is evaluated.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    big = F.length("payload") >= least
    first = rows.where(big).groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.join(first, "sha", "left").select("id", "url", "payload", (big & ~F.col("id").eqNullSafe(F.col("first.id"))).alias("again"), F.col("first.id").cast(kind).alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write the rows of ``pages`` as monolithic gzip archives into ``folder``; gives ``file, records`` (lazily: the
    files are written when it is read)."""
    joined = plan(pages, id_col, url_col, payload_col, least)
    joined = joined.select(F.monotonically_increasing_id().alias("row"), *joined.columns)  # tells records apart, no more

    def run(batches):
        import pyarrow as pa

        files, path = open_fs(folder)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        engine, n = zlib.compressobj(1, zlib.DEFLATED, 31), 0
        with files.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for row, page, url, payload, again, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(engine.compress(response(row, page, url, payload, digest(payload), REVISIT if again else RESPONSE, refers if again else None)))
                    n += 1
            out.write(engine.flush())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])
        else:
            files.delete_file(f"{path}/{name}")

    return arrow_map(joined, run, "file string, records bigint")


def spread(archives: DataFrame) -> DataFrame:
    """``archives`` with a task of its own for each few files."""
    parts = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return archives.repartition(parts, "file")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives named in ``archives.file``; gives ``file, index, records``."""

    def run(batches):
        import pyarrow as pa

        files, path = open_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                target = f"members-{uuid.uuid4().hex}-{name}"
                index = f"{target}.index"
                n = normalise_file(files, f"{path}/{name}", f"{path}/{target}", f"{path}/{index}")
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([index]), pa.array([n], pa.int64())], ["file", "index", "records"])

    return arrow_map(archives.select("file"), run, "file string, index string, records bigint")


def read(archives: DataFrame, folder: str, id_kind: str = "bigint") -> DataFrame:
    """All records of normalised archives (``file, index``): ``row, page_id, url, record_type, refers_to,
    payload_digest, payload_bytes`` and ``payload`` (null for revisits). A response's digest is checked."""

    def run(batches):
        import pyarrow as pa

        names = ["row", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        files, path = open_fs(folder)
        for batch in batches:
            for name, index in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with files.open_input_file(f"{path}/{name}") as inp, files.open_input_stream(f"{path}/{index}", compression=None) as side:
                    rest = b""
                    while True:
                        data = side.read(CHUNK)
                        *lines, rest = (rest + data).split(b"\n")
                        for line in lines:
                            entry = json.loads(line)
                            inp.seek(entry["offset"])
                            headers, block = parse(zlib.decompress(inp.read(entry["length"]), 31))
                            if headers["WARC-Record-ID"] != entry["id"]:
                                raise ValueError(f"the index of {name} doesn't fit")
                            payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == RESPONSE else None
                            sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                            if payload is not None and digest(payload) != sha:
                                raise ValueError(f"{entry['id']} in {name} is damaged")
                            rows.append((int(headers["X-Row"]), headers.get("X-Page-ID"), headers["WARC-Target-URI"], headers["WARC-Type"], headers.get("X-Refers-To"), sha, int(headers["X-Payload-Length"]), payload))
                            held += len(block)
                            if held > 4 * CHUNK:
                                yield pack(rows)
                                rows, held = [], 0
                        if not data:
                            break
                if rows:
                    yield pack(rows)

    schema = "row bigint, page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
    raw = arrow_map(archives.select("file", "index"), run, schema)
    return raw.withColumns({c: F.col(c).cast(id_kind) for c in ("page_id", "refers_to")})
