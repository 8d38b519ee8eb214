"""WARC archives: write, normalise monolithic gzip streams, and read back by offsets.

A monolithic archive is one gzip stream over all its records, in which nothing can be found without inflating all that comes
before. The normaliser inflates such a stream once, in bounded pieces, rewrites every record as a gzip member of its own
and writes a sidecar index (one JSON line per record: offset, length, id, type, digest, page), so that a reader can seek.

Files go to a folder that all executors share, through the file systems of pyarrow (file, hdfs, s3, gs), and are read so, too: Spark
deals the names of archives out, and each task opens its own. A task writes under a new name each time, and only names in the written manifest count, so that repeated
or lost tasks leave no half archive in the result. An archive is closed at `roll_bytes` of records.

Defined cases: a null html is the empty payload; a null url leaves out the target; payloads under `min_revisit` bytes are always
responses; of rows that repeat the page id and payload of a response one stays it (the smallest url) and the others revisit it; a null page id never
serves as the one referred to while its group has another; header values lose line breaks; records of any length
are kept whole; an empty table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowproof.session import saved, scratch_path

MIN_REVISIT = 100
ROLL_BYTES = 32 << 20
LEVEL = 4
PIECE = 1 << 18
#: Fixed value: the profile that the WARC 1.1 format names for revisits of identical payloads.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    return fs, path.rstrip("/")


def record_urn(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_urn(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_urn(refers_to, digest))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page", str(refers_to)))
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    head += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def inflate(data: bytes) -> Iterator[bytes]:
    """The contents of a gzip stream of one or more members, in bounded pieces."""
    at = 0
    while at < len(data):
        engine = zlib.decompressobj(31)
        while not engine.eof and at < len(data):
            piece = data[at : at + PIECE]
            at += len(piece)
            out = engine.decompress(piece, 4 * PIECE)
            while out:
                yield out
                out = b"" if engine.eof or not engine.unconsumed_tail else engine.decompress(engine.unconsumed_tail, 4 * PIECE)
            at -= len(engine.unused_data)
        if not engine.eof:
            raise ValueError("the gzip stream is cut short")
        while data[at : at + 1] == b"\0":
            at += 1


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record with its closing blank lines) of each record."""
    held, need, head = bytearray(), 0, {}
    for piece in pieces:
        held += piece
        at = 0
        while True:
            if not need:
                stop = held.find(b"\r\n\r\n", at)
                if stop < 0:
                    break
                head = parse_head(bytes(held[at:stop]))
                need = stop + 4 - at + int(head["content-length"]) + 4
            if len(held) - at < need:
                break
            yield head, bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
    if held:
        raise ValueError("the last record is cut short")


def member(record: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress(record) + engine.flush()


def decisions(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that become revisits; digests alone are shuffled."""
    seen = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= min_revisit)
    seen = seen.select("page_id", "digest")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return seen.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _repeats(rows: DataFrame) -> DataFrame:
    """The responses (page_id, digest) that several rows are, of rows with digest and revisit."""
    return rows.where(~F.col("revisit") & F.col("page_id").isNotNull()).groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"))


def _one_response(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """rows in which one of each repeated response stays a response; equal rows are summed before the shuffle, and only one payload of them is kept."""
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest"))
    once = rows.join(repeats, same, "left_anti")
    held = rows.join(repeats, same, "left_semi").groupBy("page_id", "url", "digest").agg(F.any_value("payload").alias("payload"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))  # one row for each url
    copies = held.withColumn("place", first).select("page_id", "url", "payload", "digest", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda k: (F.col("place") > 1) | (k > 1))).alias("revisit"))
    return once.unionByName(copies.withColumn("refers_to", F.when(F.col("revisit"), F.col("page_id"))))


def write_monolithic(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write every page as a record into archives of one gzip stream each; returns (archive, records)."""
    revisits = saved(decisions(pages, min_revisit), "revisits").select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "refers_to")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.col("of_digest").isNotNull().alias("revisit"), "refers_to")
    ids = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), (F.octet_length(F.coalesce("html", F.lit(""))) < min_revisit).alias("revisit"))
    ids = ids.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left_anti")
    repeats = saved(_repeats(ids), "repeats")
    if not repeats.isEmpty():
        rows = _one_response(rows, repeats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        out, engine, name, done, size = None, None, "", 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, done, size = f"crawl-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                record = write_record(*row)
                out.write(engine.compress(record))
                done, size = done + 1, size + len(record)
                if size >= roll_bytes:
                    out.write(engine.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([done], pa.int64())})
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([done], pa.int64())})

    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    return saved(rows.mapInArrow(run, "archive string, records long"), "manifest")


def _names(manifest: DataFrame) -> DataFrame:
    """The archives of a manifest, dealt out to tasks."""
    tasks = min(manifest.count(), 16 * manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("archive").repartition(max(tasks, 1))


def normalise(spark: SparkSession, folder: str, manifest: DataFrame, target: str) -> DataFrame:
    """Rewrite each archive with one gzip member per record and a sidecar index; returns (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (source, held), (fs, base) = open_folder(folder), open_folder(target)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name = f"member-{uuid.uuid4().hex}.warc.gz"
                at, done = 0, 0
                content = source.open_input_stream(f"{held}/{archive}", compression=None).read()
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out, fs.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for head, record in split_records(inflate(content)):
                        packed = member(record)
                        out.write(packed)
                        entry = {"offset": at, "length": len(packed), "id": head.get("warc-record-id"), "type": head.get("warc-type"), "digest": head.get("warc-payload-digest"), "page": head.get("x-page")}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, done = at + len(packed), done + 1
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([done], pa.int64())})

    open_folder(target)[0].create_dir(open_folder(target)[1], recursive=True)
    return saved(_names(manifest).mapInArrow(run, "archive string, records long"), "manifest")


READ_DDL = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"


def read_back(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of normalised archives, found by the sidecar's offsets; ids as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                data = memoryview(fs.open_input_stream(f"{base}/{name}", compression=None).read())
                rows = []
                for line in fs.open_input_stream(f"{base}/{name}.idx", compression=None).read().splitlines():
                    entry = json.loads(line)
                    record = zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], 31)
                    head = parse_head(record[: record.index(b"\r\n\r\n")])
                    block = record[record.index(b"\r\n\r\n") + 4 : -4]
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = head["warc-payload-digest"].partition(":")[2]
                    if head["warc-type"] == "response":
                        n = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload of {entry['id']} does not match its digest")
                    else:
                        n = int(head["x-payload-length"])
                    rows.append((head.get("x-page"), n, digest, head["warc-type"], head.get("x-refers-to-page"), head.get("warc-target-uri")))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in READ_DDL.split(", ")])

    return _names(manifest).mapInArrow(run, READ_DDL)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the pages monolithic, normalise, and read the archives back: one row per page."""
    spark = pages.sparkSession
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    crawl = write_monolithic(pages, raw, min_revisit=min_revisit)
    if crawl.isEmpty():
        return spark.createDataFrame([], f"page_id {pages.schema['page_id'].dataType.simpleString()}, payload_bytes long, payload_digest string, record_type string, refers_to {pages.schema['page_id'].dataType.simpleString()}, url string")
    rows = read_back(spark, target, normalise(spark, raw, crawl, target))
    kind = pages.schema["page_id"].dataType
    return rows.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind), "url")
