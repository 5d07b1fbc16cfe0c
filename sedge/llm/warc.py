"""WARC archives as a PySpark Python data source, and a round trip with revisit records.

Reading. The file list is planned by Spark (`archive_files`), and files are packed into partitions by size. Predicates
on record_type, and on the headers target_uri, record_id and refers_to, are pushed down. Headers are parsed first.
Archives are plain, gzip with a member per record or several, or gzip members that state their own length in an `sl`
extra field, as written here; of those the rest of a member is stepped over where the record is filtered out or its
payload is not asked for (`payload` option). In plain files a payload is stepped over as well; other gzip members have to
be unpacked to find their end, but nothing of them is decoded.

Writing. Records are written as such members, one file per task, under the file name of the task attempt; the commit
publishes a list of the files that count, so that files of lost attempts are ignored. WARC-Date is the time of writing.

Defined results: a null payload is empty; records without a target or reference have nulls there; an empty table writes
a manifest without files and reads back empty; a file that begins like neither form, or breaks off, stops the query. The
id of a record is made of the page's id and the payload's digest: rows that repeat both are the same record, written as
often as it occurs.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import cut, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload string"
PUSHED = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To"}
#: An extension header: the length of the full payload, which a revisit record does not hold.
FULL_LENGTH = "X-Payload-Length"
PARTITION_BYTES = 16 << 20
#: Revisits up to which their list is broadcast; beyond, a bit set of FILTER_BITS (least and most) tells which pages may be among them.
BROADCAST_REVISITS = 200_000
FILTER_BITS = (1 << 16, 1 << 29)
#: Words of 32 bits per piece of the bit set.
FILTER_PIECE = 2048
MANIFEST = "files-"
#: What stands for characters of ids in record ids; the percent sign comes first.
ESCAPES = {"%": "%25", "\n": "%0A", "\r": "%0D"}
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text or binary column: every five hex digits are four base-32 digits."""
    digest = F.sha1(data.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}" if path.startswith(("/", "file:")) else path)


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with the skip-length extra field: compressed and plain length of the whole member."""
    packed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row, date: str) -> bytes:
    payload = (row["payload"] or "").encode("utf-8", "surrogatepass") if row["record_type"] != "revisit" else b""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8"]
    for name, value in (("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Payload-Digest", row["payload_digest"] and f"sha1:{row['payload_digest']}"), (FULL_LENGTH, row["payload_bytes"])):
        if value is not None:
            lines.append(f"{name}: {str(value).translate({10: ' ', 13: ' '})}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def headers(text: bytes) -> dict[str, str]:
    lines = _text(text).split("\r\n")
    return {name.strip(): value.strip() for name, colon, value in (x.partition(":") for x in lines[1:]) if colon}


def _text(block: bytes) -> str:
    try:
        return block.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return block.decode("utf-8", "replace")


def records(stream, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], str | None]]:
    """Headers and payload (None where it is not asked for) of the records whose headers `wanted` accepts."""
    fixed = stream.read(24)
    if fixed[:2] == b"\x1f\x8b" and fixed[3] & 4 and fixed[12:16] == b"sl\x08\x00":
        yield from sized_records(stream, wanted, with_payload)
    elif fixed:
        stream.seek(0)
        yield from sequential_records(stream, fixed[:2] == b"\x1f\x8b", wanted, with_payload)


def sequential_records(stream, packed: bool, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], str | None]]:
    """Records of a plain or an ordinary gzip file, one after the other."""
    lines = io.BufferedReader(gzip.GzipFile(fileobj=stream) if packed else stream, 1 << 16)
    while line := lines.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = [line.rstrip(b"\r\n")]
        while (line := lines.readline()).strip():
            head.append(line.rstrip(b"\r\n"))
        fields = headers(b"\r\n".join(head))
        length, take = int(fields.get("Content-Length", 0)), wanted(fields)
        if take and with_payload:
            block = lines.read(length)
            if len(block) < length:
                raise EOFError("a WARC record breaks off")
            yield fields, _text(block)
            continue
        if packed:
            while length > 0 and (part := lines.read(min(length, 1 << 16))):
                length -= len(part)
        else:
            lines.seek(length, 1)
        if take:
            yield fields, None


def sized_records(stream, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], str | None]]:
    """Records of gzip members that state their length: only what is asked for is unpacked."""
    at = 0
    while True:
        stream.seek(at)
        fixed = stream.read(24)
        if not fixed:
            return
        if len(fixed) < 24 or fixed[:2] != b"\x1f\x8b" or fixed[12:16] != b"sl\x08\x00":
            raise ValueError("a WARC member is damaged")
        total = struct.unpack("<I", fixed[16:20])[0]
        at, left = at + total, total - len(fixed)
        unpack, plain = zlib.decompressobj(-15), b""
        while b"\r\n\r\n" not in plain and left > 8:
            chunk = stream.read(min(left, 1024))
            if not chunk:
                raise EOFError("a WARC record breaks off")
            left -= len(chunk)
            plain += unpack.decompress(chunk, 4096)
            while unpack.unconsumed_tail and b"\r\n\r\n" not in plain:
                plain += unpack.decompress(unpack.unconsumed_tail, 4096)
        head, _, start = plain.partition(b"\r\n\r\n")
        fields = headers(head)
        if not wanted(fields):
            continue
        payload = None
        if with_payload:
            body = start + unpack.decompress(unpack.unconsumed_tail) + unpack.decompress(stream.read(left)) + unpack.flush()
            payload = _text(body[: int(fields.get("Content-Length", 0))])
        yield fields, payload


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.accepted: list[tuple[str, set | None]] = []  # header and its values; None: any

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name in PUSHED:
                values = None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.accepted.append((PUSHED[name], values))
            else:
                yield f

    def partitions(self):
        packs, size = [[]], 0
        for path, length in sorted(self.files):
            if packs[-1] and size + length > self.partition_bytes:
                packs.append([])
                size = 0
            packs[-1].append(path)
            size += length
        return [Files(p) for p in packs]

    def read(self, partition):
        def wanted(fields):
            return all(name in fields if values is None else fields.get(name) in values for name, values in self.accepted)

        for path in partition.paths:
            system, inside = filesystem(path)
            with system.open_input_file(inside) as stream:
                for f, payload in records(stream, wanted, self.with_payload):
                    digest = f.get("WARC-Payload-Digest")
                    yield (f.get("WARC-Record-ID"), f.get("WARC-Type"), f.get("WARC-Target-URI"), f.get("WARC-Refers-To"), digest and digest.removeprefix("sha1:"), int(f.get(FULL_LENGTH, f.get("Content-Length", 0))), payload)


class Written(WriterCommitMessage):
    def __init__(self, files: list):
        self.files = files


class WarcWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.date = options["path"].rstrip("/"), time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def write(self, iterator):
        system, inside = filesystem(self.path)
        system.create_dir(inside, recursive=True)
        name, size, stream = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for row in iterator:
            stream = stream or system.open_output_stream(f"{inside}/{name}", compression=None)
            data = member(record(row, self.date))
            stream.write(data)
            size += len(data)
        if stream:
            stream.close()
        return Written([[f"{self.path}/{name}", size]] if stream else [])

    def commit(self, messages):
        system, inside = filesystem(self.path)
        system.create_dir(inside, recursive=True)
        with system.open_output_stream(f"{inside}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write("".join(json.dumps(f) + "\n" for m in messages if m for f in m.files).encode())

    def abort(self, messages):
        system, _ = filesystem(self.path)
        for m in messages:
            for path, _size in m.files if m else []:
                system.delete_file(filesystem(path)[1])


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archive(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.select(*[x.split()[0] for x in SCHEMA.split(", ")]).write.format("warc").mode("append").save(path)


def archive_files(spark: SparkSession, path: str) -> list[list]:
    """Path and length of the files that a commit has published, one short line per file; without a manifest, of all .warc and .warc.gz files there."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if listed.option("pathGlobFilter", f"{MANIFEST}*.json").load(path).select("path").isEmpty():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc{,.gz}").load(path).select("path", "length")
        return [[r["path"], r["length"]] for r in files.toLocalIterator()]
    lines = spark.read.text(f"{path}/{MANIFEST}*.json")
    return [[p, int(n)] for p, n in (json.loads(r["value"]) for r in lines.toLocalIterator())]


def read_archive(spark: SparkSession, path: str, *, payload: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("files", json.dumps(archive_files(spark, path))).option("payload", str(payload).lower()).option("partitionBytes", partition_bytes).load()


def with_revisits(pages: DataFrame, *, id_column: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """A record per page: of equal payloads of at least least_bytes, that with the smallest id is a response, others revisit it.

    Only ids and digests are shuffled to find the first of equal payloads. Payloads are shuffled only where the revisits are
    too many to be broadcast, and then only those of pages that a bit set of the revisits does not rule out. Repeated rows
    with the smallest id are all responses; pages with a null id are responses and revisited by none.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    marked = pages.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{url}`").alias("target_uri"), payload.alias("payload"), base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    # Of digests that occur once nothing is needed: the list to join is that of repeated payloads.
    keys = cut(marked.where(F.col("id").isNotNull() & (F.col("payload_bytes") >= least_bytes)).select("id", "payload_digest", "payload_bytes"))
    first = keys.groupBy("payload_digest", "payload_bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # An id may have several payloads (a recrawl): only the row with the repeated one is a revisit.
    on = ["id", "payload_digest", "payload_bytes"]
    later = cut(keys.join(first, ["payload_digest", "payload_bytes"]).where("id <> first").select(*on, "first").distinct())
    n = later.count()
    if n <= BROADCAST_REVISITS:
        rows = marked.join(F.broadcast(later), on, "left")
    else:
        marked = marked.withColumn("maybe", maybe_among(later, n, on)(F.xxhash64(*on)))
        sure = marked.where("NOT maybe").drop("maybe").withColumn("first", F.lit(None).cast(later.schema["first"].dataType))
        rows = sure.unionByName(marked.where("maybe").drop("maybe").join(later, on, "left"))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), escaped(c.cast("string")), F.lit(":"), F.col("payload_digest"), F.lit(">"))
    return rows.select(F.coalesce(record_id(F.col("id")), F.concat(F.lit("<urn:no-page:"), "payload_digest", F.lit(">"))).alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("target_uri").cast("string"), record_id(F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))


def maybe_among(rows: DataFrame, n: int, on: list[str]):
    """A column function xxhash64(on) -> false where the key is certainly not among the n rows, by a bit set of bounded size."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (8 * n).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    words = rows.select(place.alias("p")).selectExpr("p div 32 AS w", "shiftleft(1L, cast(p % 32 AS int)) AS b")

    def piece(found: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(FILTER_PIECE, np.uint32)
        own[found["w"].to_numpy(np.int64) % FILTER_PIECE] = found["b"].to_numpy(np.int64).astype(np.uint32)
        return pd.DataFrame({"k": found["k"].iloc[:1], "data": [own.tobytes()]})

    # The set itself passes the driver, in pieces of words, not a row for each of its words.
    joined = words.groupBy("w").agg(F.bit_or("b").alias("b")).withColumn("k", F.expr(f"w div {FILTER_PIECE}"))
    table = np.zeros(bits // 32, np.uint32)
    for r in joined.groupBy("k").applyInPandas(piece, "k bigint, data binary").toLocalIterator():
        table[r["k"] * FILTER_PIECE : (r["k"] + 1) * FILTER_PIECE] = np.frombuffer(r["data"], np.uint32)
    held = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        at = np.mod(keys.to_numpy(np.int64), bits)
        return pd.Series((held.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

    return maybe


def escaped(text: Column) -> Column:
    """Line breaks, which would end a header, and the percent sign as percent codes."""
    for plain, code in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def page_of(uri: Column) -> Column:
    """The page's id, as text, in a record id; null for other ids and where the page has none."""
    form = r"(?s)^<urn:page:(.*):[A-Z2-7]{32}>$"
    found = F.regexp_extract(uri, form, 1)
    for plain, code in reversed(ESCAPES.items()):
        found = F.replace(found, F.lit(code), F.lit(plain))
    return F.when(uri.rlike(form), found)


def verified(records: DataFrame) -> DataFrame:
    """records, read with payloads, where digest and length of responses come from the payload itself; a header that differs stops the query."""
    digest, size = base32_sha1(F.col("payload")), F.octet_length("payload").cast("bigint")
    full = F.col("record_type") != "revisit"  # a revisit record has headers only
    agree = digest.eqNullSafe(F.col("payload_digest")) & size.eqNullSafe(F.col("payload_bytes"))
    fault = F.raise_error(F.concat(F.lit("payload differs from its headers: "), F.coalesce("record_id", F.lit("no id"))))
    return records.withColumns({"payload_digest": F.when(full & ~agree, fault.cast("string")).when(full, digest).otherwise(F.col("payload_digest")), "payload_bytes": F.when(full, size).otherwise(F.col("payload_bytes"))})


def report(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back with payloads, verify these, and give a row per record."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(with_revisits(pages), path)
    back, kind = verified(read_archive(spark, path)), pages.schema["page_id"].dataType
    return back.select(page_of(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).cast(kind).alias("refers_to"))
