"""Deterministic sharded WARC writer, and its reader.

Records are put in order by page id and rolled into files by compressed size; every record is a gzip member of its own.
The order and the files are found on ids, digests and sizes alone; a record's bytes are sent once, to its file. Spark's
writer writes the files under temporary names on whatever file system the folder lies; then the driver gives them their
final names and writes a manifest, without which a folder counts as not written. A file's name and bytes hang on the rows
alone, not on how they were dealt to tasks.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm._shared import Scratch, chunks, record
from tidewave.llm.skew import spread_join

#: Payloads of so many bytes are written once; equal ones revisit that record.
REVISIT_BYTES = 1000
#: A file ends with the record that takes it to so many compressed bytes.
ROLL_BYTES = 16 << 20
#: With more files than this, files are larger; so many first records go to all tasks.
MOST_FILES = 200_000
#: Rows of ids, digests and sizes that one task puts in order.
ORDERED = 1_000_000
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
MANIFEST = "manifest.json"


def record_bytes(page_id: int, url: str | None, payload: bytes | None, sha: bytes, n: int, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed: of payload, or a revisit of refers_to with a payload of this SHA-1 and n bytes.

    Headers are made anew; ids hang on page and payload.
    """
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{sha.hex()}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http if payload is None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c > ' ' and c != chr(127))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {page_id}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member without time or name, followed by an empty one if its last byte were not zero."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = c.compress(record) + c.flush()
    if out[-1]:
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += c.compress(b"") + c.flush()
    return out


def records(data: bytes | memoryview, step: int = 1 << 16):
    """(headers, block) of each record of a file of gzip members; lengths, ends and block digests are checked."""
    data, at = memoryview(data), 0
    while at < len(data):
        d, raw = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("a WARC file ends within a record")
            part = data[at : at + step]
            raw.append(d.decompress(part))
            at += len(part)
        at -= len(d.unused_data)
        raw = b"".join(raw)
        if not raw:
            continue
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(fields["Content-Length"])
        block = rest[:n]
        if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
            raise ValueError(f"a damaged WARC record: {fields.get('WARC-Record-ID')}")
        yield fields, block


#: k numbers the rows, in no order that counts; tie tells records of one page apart; n counts the payload's bytes.
MEMBERS = pa.schema([("k", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("size", pa.int64()), ("gz", pa.binary())])
PLACED = pa.schema([("page_id", pa.int64()), ("tie", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("part", pa.int64())])


def _ddl(s: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary'})[f.type]}" for f in s)


def _responses(batches):
    """Each row's record, as if it were a response."""
    for b in chunks(batches, "payload"):
        out = []
        for k, page, url, payload in zip(*(b.column(c).to_pylist() for c in ("k", "page_id", "url", "payload")), strict=True):
            sha = hashlib.sha1(payload)
            gz = member(record_bytes(page, url, payload, sha.digest(), len(payload)))
            out.append((k, page, url, sha.hexdigest(), len(payload), len(gz), gz))
        yield record(MEMBERS, *zip(*out, strict=True))


def _revisit_records(batches):
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("k", "page_id", "url", "digest", "n", "refers_to")]
        gz = [member(record_bytes(page, url, None, bytes.fromhex(digest), n, refers_to)) for _, page, url, digest, n, refers_to in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("page_id"), b.column("tie"), pa.array([len(x) for x in gz], pa.int64()), pa.array(gz, pa.binary())], ["k", "page_id", "tie", "size", "gz"])


def revisits(light: DataFrame) -> DataFrame:
    """light (page_id, digest, n) -> (page_id, digest, refers_to, n of rows) where a larger page_id has the same large payload."""
    large = light.where(F.col("n") >= REVISIT_BYTES).groupBy("page_id", "digest").agg(F.count("*").alias("rows"))
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return spread_join(large, last, ["digest"], F.col("page_id")).where("page_id < refers_to").select("page_id", "digest", "refers_to", F.col("rows").alias("n"))


def _starts(batches):
    """Where each record begins if those of this task, in order, lay one after another."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        size = np.asarray(b.column("size"))
        ends = at + np.cumsum(size)
        yield record(PLACED, b.column("page_id"), b.column("tie"), b.column("k"), ends - size, size, np.full(len(size), part))
        at = int(ends[-1]) if len(ends) else at


def _without_superseded(batches):
    """The records of a file in order; a revisit, which comes first, takes the place of the response of the same k."""
    before = None
    for b in batches:
        k = np.asarray(b.column("k"))
        if len(k):
            keep = np.r_[before is None or k[0] != before, k[1:] != k[:-1]]
            before = k[-1]
            yield b.select(["gz", "file"]).filter(pa.array(keep))


def file_of(bounds: list[tuple[int, int, int]], page: np.ndarray, tie: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The file of each record; bounds are the first records of the files, in order."""
    first = np.array([x[0] for x in bounds], np.int64)
    lo, hi = np.searchsorted(first, page), np.searchsorted(first, page, "right")
    out = hi - 1
    # files that begin within a page's records
    for i in np.flatnonzero(hi > lo).tolist():
        out[i] = bisect.bisect_right(bounds, (int(page[i]), int(tie[i]), int(k[i]))) - 1
    return out


def write(pages: DataFrame, folder: str, scratch: Scratch, payload: str = "html", roll: int = ROLL_BYTES) -> DataFrame:
    """Write one record for each row of pages (page_id, url, payload as text) with an id; the manifest as a DataFrame.

    A null payload is an empty one, a null url an empty target. Of repeated rows of one id each gets its record, all of them
    of the largest id's kind. Ties of an id are ordered by hashes of payload and url. Rows without page_id have no record.
    Other columns are ignored. A task holds a file's records at most, and payloads are compressed before anything is sent.
    """
    spark = pages.sparkSession
    p = pages.where(F.col("page_id").isNotNull()).select(F.monotonically_increasing_id().alias("k"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("payload"))
    made = scratch.save(p.mapInArrow(_responses, _ddl(MEMBERS)), "members").withColumn("tie", F.xxhash64("digest", "url"))
    kinds = spread_join(made.select("k", "page_id", "tie", "url", "digest", F.col("n").alias("bytes")), scratch.save(revisits(made), "kinds"), ["page_id", "digest"], F.col("k"))
    again = scratch.save(kinds.withColumnRenamed("bytes", "n").mapInArrow(_revisit_records, "k long, page_id long, tie long, size long, gz binary"), "revisits")
    key = ["page_id", "tie", "k"]
    sizes = made.select(*key, "size").join(again.select("k", F.col("size").alias("own")), "k", "left").select(*key, F.coalesce("own", "size").alias("size"))
    rows = made.count()
    placed = scratch.save(sizes.repartitionByRange(max(1, -(-rows // ORDERED)), *key).sortWithinPartitions(*key).mapInArrow(_starts, _ddl(PLACED)), "placed")
    # one row for ORDERED records meets in one task
    parts = placed.groupBy("part").agg(F.sum("size").alias("total"))
    base = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    total = parts.agg(F.sum("total")).first()[0] or 0
    each = max(roll, -(-total // MOST_FILES))
    files = placed.join(parts.select("part", base), "part").groupBy(F.floor((F.col("base") + F.col("start")) / each).alias("file")).agg(F.min(F.struct(*key)).alias("first"))
    bounds = [tuple(r) for r in files.orderBy("file").select("first.*").collect()]
    if bounds:
        sent = spark.sparkContext.broadcast(bounds)

        def deal(batches):
            for b in batches:
                at = file_of(sent.value, *(np.asarray(b.column(c)) for c in key))
                yield b.append_column("file", pa.array(at, pa.int64()))

        both = again.select(*key, F.lit(0).alias("kind"), "gz").union(made.select(*key, F.lit(1).alias("kind"), "gz"))
        dealt = both.mapInArrow(deal, "page_id long, tie long, k long, kind int, gz binary, file long")
        dealt = dealt.repartitionById(len(bounds), F.col("file").cast("int")).sortWithinPartitions("file", *key, "kind").mapInArrow(_without_superseded, "gz binary, file long")
        # the writer ends each value with the separator: a zero, which every member ends with
        lines = dealt.select(F.expr("substring(gz, 1, length(gz) - 1)").cast("string").alias("value"), "file")
        lines.write.mode("overwrite").partitionBy("file").option("lineSep", "\x00").text(f"{folder}/_parts")
    else:
        spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_parts").getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_parts"))
    scratch.drop("members", "kinds", "revisits", "placed")
    return commit(spark, folder)


def commit(spark: SparkSession, folder: str) -> DataFrame:
    """Give the parts their final names, in order, and write the manifest last."""
    jvm = spark._jvm
    path = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join(x))
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    listed = []
    for d in fs.listStatus(path(folder, "_parts")):
        if d.isDirectory():
            for f in fs.listStatus(d.getPath()):
                if f.getLen():
                    listed.append((int(d.getPath().getName().partition("=")[2]), f.getPath().getName(), f.getPath(), f.getLen()))
    named = []
    for k, (_, _, at, n) in enumerate(sorted(listed, key=lambda x: x[:2])):
        name = f"pages-{k:06d}.warc.gz"
        if not fs.rename(at, path(folder, name)):
            raise OSError(f"{name} could not be given its name")
        named.append((name, int(n)))
    out = fs.create(path(folder, f"{MANIFEST}.tmp"), True)
    out.write(bytearray(json.dumps({"files": [{"name": n, "bytes": b} for n, b in named]}).encode()))
    out.close()
    fs.delete(path(folder, MANIFEST), False)
    fs.rename(path(folder, f"{MANIFEST}.tmp"), path(folder, MANIFEST))
    fs.delete(path(folder, "_parts"), True)
    return spark.createDataFrame(named, "name string, bytes long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the files that the manifest names. A revisit has no payload, and null payload_bytes.

    A folder without records gives no rows; a damaged record or one that is cut off is an error.
    """
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{folder}/{MANIFEST}").collect()))
    if not manifest["files"]:
        return spark.createDataFrame([], READ)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                out = []
                for fields, block in records(content.as_buffer()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2])
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"a payload's digest is wrong: {fields['WARC-Record-ID']}")
                    out.append((int(fields["X-Page-Id"]), None if revisit else len(payload), digest.hex(), fields["WARC-Type"], int(fields["X-Refers-To-Page-Id"]) if revisit else None, fields["WARC-Target-URI"], payload if payloads and not revisit else None))
                    if len(out) == 500:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    files = spark.read.format("binaryFile").load([f"{folder}/{f['name']}" for f in manifest["files"]])
    return files.select("content").mapInArrow(run, READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def round_trip(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Write pages as WARC and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Rows without page_id are not written and so don't come back; repeated rows come back as often.
    """
    s = Scratch(pages.sparkSession, "warc")
    folder = f"{s.root}/archive"
    write(pages, folder, s, payload)
    back = s.save(read(pages.sparkSession, folder, payloads=False).drop("payload"), "back")
    # a revisit's payload is as long as that of the record it names; very many may name one
    key = ["refers_to", "payload_digest"]
    visits = back.where("record_type = 'revisit'")
    named = back.where("record_type = 'response' and payload_bytes >= %d" % REVISIT_BYTES).groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    asked = s.save(visits.groupBy(*key).agg(F.count("*").alias("n")).join(named, key, "left"), "asked")
    out = spread_join(visits.drop("payload_bytes"), asked, key, F.col("page_id"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return back.where("record_type <> 'revisit'").select(*columns).union(out.select(*columns))
