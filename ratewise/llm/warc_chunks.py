"""WARC archives through a chunked record table.

A payload is never handled whole after its row: Spark deals it out as
(record, chunk number) rows, and the tasks that digest, write and read
archives take one chunk at a time, carrying the SHA-1 of the chunks so far.
Archives are gzip members, one a record, written through ``pyarrow.fs`` to the
folder given (any file system it resolves). Each writing attempt has its own
file names, and only the files of attempts that Spark commits are listed, so a
lost executor leaves no half-written archive behind in the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, materialize, scratch_dir, shuffle_partitions, text_bytes, with_bit

#: Of a payload; Arrow batches of 10,000 chunks then stay under 160 MB.
CHUNK_BYTES = 1 << 14
#: An archive file is closed at the end of the record that takes it past this size.
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_rows(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per chunk of column ``payload``: the other columns, chunk_no, last and chunk; an empty payload has one."""
    keep = [c for c in rows.columns if c != "payload"]
    n = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk_bytes)).cast("int")
    cut = rows.withColumn("_n", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    chunk = F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})").alias("chunk")
    return cut.select(*keep, "chunk_no", (F.col("chunk_no") == F.col("_n") - 1).alias("last"), chunk)


def digests(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(page_id, payload_bytes, sha1) of each row of (page_id, payload), from its chunks in order."""
    def run(batches):
        import hashlib

        import pyarrow as pa

        sha, size = None, 0
        for batch in batches:
            out = []
            for i, (no, last) in enumerate(zip(batch.column("chunk_no").to_pylist(), batch.column("last").to_pylist())):
                if no == 0:
                    sha, size = hashlib.sha1(), 0
                chunk = batch.column("chunk")[i].as_buffer()
                if chunk is not None:
                    sha.update(chunk)
                    size += len(chunk)
                if last:
                    out.append((i, size, sha.hexdigest()))
            ids = batch.column("page_id").take(pa.array([i for i, _, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n, _ in out], pa.int64()), pa.array([s for _, _, s in out], pa.string())], ["page_id", "payload_bytes", "sha1"])

    rows = pages.select("page_id", "payload")
    return chunk_rows(rows, chunk_bytes).mapInArrow(run, f"page_id {rows.schema[0].dataType.simpleString()}, payload_bytes long, sha1 string")


def decide(found: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, payload_bytes, refers_to): refers_to is null for responses.

    Of equal payloads of at least ``min_bytes`` the record with the smallest
    page_id is the response; a null id never is, unless all are. Rows that
    repeat an id and its payload are decided alike.
    """
    firsts = found.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1").drop("n"), "firsts")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    return found.distinct().join(firsts, ["sha1", "payload_bytes"], "left").select("page_id", "sha1", "payload_bytes", refers)


def _head(page_id, url, refers_to, size, sha1, date):
    """The WARC and HTTP headers of a record. Ids are percent-encoded, so any text is one header line; null has a name of its own."""
    import base64
    from urllib.parse import quote

    def urn(i):
        return "<urn:x-no-page>" if i is None else f"<urn:x-page:{quote(str(i), safe='')}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,-./:;=?@[]_~' + chr(39))}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        *([f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row and return the list of archives: path, bytes, records.

    Null payloads are empty payloads; null urls leave out the target. An empty
    table writes nothing. Other columns are ignored. Rows that are surely no
    revisits are written chunk by chunk where they are read; only those that may
    be (bit filter of at most 16 MB) meet the list of revisits, as chunks.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_bytes(payload_col).alias("payload"))
    plan = materialize(decide(materialize(digests(rows, chunk_bytes), "digests"), min_bytes), "records")
    revisits = materialize(plan.where("refers_to is not null").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "refers_to"), "revisits")
    named = lambda i, h: F.xxhash64(F.coalesce(F.col(i).cast("string"), F.lit(" ")), h)
    told = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("_h", named("page_id", "sha1"))
    told = with_bit(told, "_h", bit_filter(revisits.select(named("_id", "_sha1").alias("_h")), "_h")).drop("_h")
    cols = ["page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk_no", "last", "chunk"]
    responses = chunk_rows(told.where("not _maybe").drop("_maybe"), chunk_bytes).withColumn("refers_to", F.lit(None).cast(plan.schema["refers_to"].dataType))
    # chunks of a record come from one task, so the sort by its number brings them together whatever Spark joins by
    others = chunk_rows(told.where("_maybe").drop("_maybe").withColumn("_rid", F.monotonically_increasing_id()), chunk_bytes)
    others = others.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left").where("refers_to is null or chunk_no = 0")
    others = others.withColumn("chunk", F.when(F.col("refers_to").isNull(), F.col("chunk")).otherwise(F.lit(b""))).withColumn("last", F.col("last") | F.col("refers_to").isNotNull())
    records = responses.select(*cols).unionByName(others.sortWithinPartitions("_rid", "chunk_no").select(*cols))

    def run(batches):
        import uuid
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        base, top = folder.rstrip("/"), root.rstrip("/")
        out, done, held = None, [], [0, 0, ""]
        packer = None
        store.create_dir(root, recursive=True)
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk_no", "last")}
            for i in range(batch.num_rows):
                if out is None:
                    held = [0, 0, f"{uuid.uuid4().hex}.warc.gz"]
                    out = store.open_output_stream(f"{top}/{held[2]}", compression=None)
                if cols["chunk_no"][i] == 0:
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    head = packer.compress(_head(*(cols[c][i] for c in ("page_id", "url", "refers_to", "payload_bytes", "sha1")), date))
                    held[0] += out.write(head) if head else 0
                chunk = batch.column("chunk")[i].as_buffer()
                if chunk is not None and len(chunk) and (data := packer.compress(chunk)):
                    held[0] += out.write(data)
                if cols["last"][i]:
                    held[0] += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    held[1] += 1
                    if held[0] > file_bytes:
                        out.close()
                        out = None
                        done.append(held)
        if out is not None:
            out.close()
            done.append(held)
        yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{x[2]}" for x in done], pa.string()), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())], ["path", "bytes", "records"])

    return materialize(records.mapInArrow(run, "path string, bytes long, records long"), "archives")


class Reader:
    """Streams an archive: a bounded buffer over its gzip members."""

    def __init__(self, stream, step: int = 1 << 18):
        import zlib

        self.stream, self.step, self.zlib = stream, step, zlib
        self.member, self.buffer, self.left = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """At most ``step`` bytes more into the buffer; false at the end."""
        while True:
            raw = self.left or self.stream.read(self.step)
            if not raw:
                return False
            data = self.member.decompress(raw, self.step)
            self.left = self.member.unconsumed_tail
            if self.member.eof:
                self.left, self.member = self.member.unused_data, self.zlib.decompressobj(31)
            if data:
                self.buffer += data
                return True

    def head(self) -> bytes | None:
        """Up to the next empty line."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 4:]
        return out

    def take(self, n: int) -> bytes:
        """Between 1 and n bytes."""
        if not self.buffer and not self.more():
            raise EOFError("the archive ends within a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives listed in ``archives`` (column path).

    record_id, record_type, target_uri, refers_to, stated_digest, stated_bytes,
    chunk_no, last, offset, sha1 (of the payload up to this chunk's end, base32)
    and, with ``with_data``, data. A record without payload has one empty chunk.
    A task holds one chunk, whatever the record's size.
    """
    schema = "record_id string, record_type string, target_uri string, refers_to string, stated_digest string, stated_bytes long, chunk_no int, last boolean, offset long, size long, sha1 string"
    schema += ", data binary" if with_data else ""

    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

        def chunks(path):
            store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            with store.open_input_stream(at, compression=None) as stream:
                reader = Reader(stream)
                while (head := reader.head()) is not None:
                    warc = _fields(head)
                    before = len(http := reader.head()) + 4
                    left = int(warc["content-length"]) - before
                    about = (warc["warc-record-id"], warc["warc-type"], warc.get("warc-target-uri"), warc.get("warc-refers-to"),
                             warc.get("warc-payload-digest", "").removeprefix("sha1:"), int(_fields(http).get("content-length", 0)))
                    sha, no, offset = hashlib.sha1(), 0, 0
                    while True:
                        parts, size = [], 0
                        while size < min(chunk_bytes, left):
                            parts.append(reader.take(min(chunk_bytes, left) - size))
                            sha.update(parts[-1])
                            size += len(parts[-1])
                        left -= size
                        row = (*about, no, left == 0, offset, size, base64.b32encode(sha.digest()).decode())
                        yield (*row, b"".join(parts)) if with_data else row
                        no, offset = no + 1, offset + size
                        if not left:
                            break
                    while len(reader.buffer) < 4 and reader.more():
                        pass
                    reader.buffer = reader.buffer[4:]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in chunks(path):
                    rows.append(row)
                    held += row[9] if with_data else 0
                    if len(rows) >= 2000 or held >= 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    spread = archives.select("path").repartition(shuffle_partitions(archives.sparkSession), "path")
    return spread.mapInArrow(run, schema)


def revisit_table(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back, and return a row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.
    Size and digest of a response are of the bytes read back; a revisit takes
    them from the response that it refers to by id and stated digest, so that
    ids which repeat with other payloads don't mix. An empty table gives no rows.
    """
    import uuid

    folder = folder or f"{scratch_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    kind = pages.schema["page_id"].dataType
    table = read_archives(write_archives(pages, folder, min_bytes=min_bytes), with_data=False).where("last")

    def page(c):
        name = F.regexp_extract(c, "(?s)^<urn:x-page:(.*)>$", 1)
        return F.when(F.col(c).startswith("<urn:x-page:"), F.url_decode(name)).cast(kind)

    records = materialize(table.select(page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"), "stated_digest",
                                       (F.col("offset") + F.col("size")).alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "target_uri"), "read-back")
    responses = records.where("record_type = 'response'")
    first = responses.where("page_id is not null").select(F.col("page_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).distinct()
    named = (F.col("refers_to") == F.col("_id")) & (F.col("stated_digest") == F.col("_digest"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, named)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    return responses.select(*cols).unionByName(revisits.withColumnsRenamed({"_bytes": "payload_bytes", "_digest": "payload_digest"}).select(*cols))
