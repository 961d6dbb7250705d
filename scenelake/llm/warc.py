"""WARC archives: write them, index them, and read selected records by byte ranges.

Writing. Rows are dealt to archives by ranges of their key. Each task writes one archive to a name of its own
attempt and gives back the index of what it wrote: archive, offset, length, URL, digest. The index is stored as
a table, and only what it names is part of the result; a task that is run again leaves an archive nobody names.
Of records with equal payloads the one with the largest key is the response and the others revisit it, which is
decided on digests before anything is written.

Reading. The index is joined to what is asked for, sorted by archive and offset, and byte ranges that touch or
lie less than `gap` apart are read at once.

Archives are reached through `pyarrow.fs`, so the folder may be a local path or in any store that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import table, text_of
from scenelake.session import cut_lineage, run_folder

INDEX = (
    "archive string, offset long, length long, key long, url string, record_type string, digest string, "
    "refers_to long"
)
RECORD = INDEX.replace("length long", "length long, payload_bytes long") + ", payload binary"


@dataclass(frozen=True)
class WarcSettings:
    """`rows`: records in an archive, about. `least_bytes`: smaller payloads are all responses. `gap`: bytes
    that are read along rather than reading twice. `most_read`: bytes read at once, but one record is always.
    `date`: of the records; fixed, so that the same rows give the same archives."""

    rows: int = 4000
    least_bytes: int = 0
    gap: int = 4096
    most_read: int = 8 << 20
    date: datetime = datetime(2024, 1, 1, tzinfo=timezone.utc)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(key: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=key & (1 << 128) - 1)}>"


def _key(record_id: str) -> int:
    low = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _record(kind: str, key: int, url: str, digest: str, size: int, refers_to: int | None, payload: bytes, date) -> bytes:
    """One record, a gzip member of its own."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(key)}",
        f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
        # A line break would end the header.
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_id(refers_to)}",
        ]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in folder and ":" in folder:  # file:/a
        folder = folder.replace(":/", ":///", 1)
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def decide(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """(key, refers_to) of the rows of (key, digest, size): null for a response, else the response's key.

    The largest key of a digest comes from a grouped maximum, which is summed up before the shuffle; the join
    back is one that adaptive execution splits when a payload is very common.
    """
    kept = pages.where(F.col("size") >= settings.least_bytes)
    first = kept.groupBy("digest").agg(F.max("key").alias("response"))
    return kept.join(first, "digest").where("key < response").select("key", F.col("response").alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    settings: WarcSettings = WarcSettings(),
) -> DataFrame:
    """Writes a record per row to archives in `folder`; returns their index, stored beside them.

    Null payloads and URLs are empty. Keys are whole numbers; rows with a null key have nothing to be found by
    and are left out. Rows that repeat a key are written each, all as responses or as revisits of a larger key.
    An empty table gives an empty index. Other columns aren't read.
    """
    spark = pages.sparkSession
    rows = pages.select(
        pages[key].cast("long").alias("key"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"),
        text_of(pages, payload).alias("payload"),
    ).where("key is not null")
    # SHA-1 in hexadecimal tells payloads apart as well as its other spellings.
    sums = cut_lineage(rows.select("key", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")))
    revisits = cut_lineage(decide(sums, settings).distinct())
    # A revisit's payload isn't written, only its digest and size; so it needn't be moved either.
    joined = rows.join(revisits, "key", "left")
    archives = max(1, -(-sums.count() // settings.rows))
    date = settings.date

    def write(batches):
        store, base = _store(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        store.create_dir(base, recursive=True)
        offset, out = 0, None
        try:
            for batch in batches:
                entries = []
                for row in batch.to_pylist():
                    data = row["payload"].encode()
                    kind = "response" if row["refers_to"] is None else "revisit"
                    digest = digest_of(data)
                    record = _record(kind, row["key"], row["url"], digest, len(data), row["refers_to"], data, date)
                    if out is None:
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(record)
                    entries.append((name, offset, len(record), row["key"], row["url"], kind, digest, row["refers_to"]))
                    offset += len(record)
                if entries:
                    columns = list(zip(*entries))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                    names = [part.split()[0] for part in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    index = joined.repartitionByRange(archives, "key").sortWithinPartitions("key").mapInArrow(write, INDEX)
    index.write.parquet(f"{folder.rstrip('/')}/index.parquet")
    return spark.read.parquet(f"{folder.rstrip('/')}/index.parquet")


def read_records(index: DataFrame, folder: str, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """The records that `index` (or a part of it) names, parsed: index columns as the archive itself has them,
    `payload` (null for a revisit) and its `payload_bytes`."""

    def read(batches):
        store, base = _store(folder)
        opened: tuple[str, object] | None = None
        for batch in batches:
            wanted = sorted(batch.to_pylist(), key=lambda r: (r["archive"], r["offset"]))
            groups: list[list[dict]] = []
            for r in wanted:
                last = groups[-1] if groups else None
                near = last and last[-1]["archive"] == r["archive"] and (
                    r["offset"] - (last[-1]["offset"] + last[-1]["length"]) <= settings.gap
                ) and r["offset"] + r["length"] - last[0]["offset"] <= settings.most_read
                if near:
                    last.append(r)
                else:
                    groups.append([r])
            for group in groups:
                name, begin = group[0]["archive"], group[0]["offset"]
                if opened is None or opened[0] != name:
                    opened = name, store.open_input_file(f"{base}/{name}")
                size = max(r["offset"] + r["length"] for r in group) - begin
                data = memoryview(opened[1].read_at(size, begin))
                out = []
                for r in group:
                    at = r["offset"] - begin
                    headers, block = parse_record(data[at : at + r["length"]])
                    kind, refers = headers["warc-type"], headers.get("warc-refers-to")
                    response = kind == "response"
                    out.append((
                        name, r["offset"], r["length"], len(block) if response else None,
                        _key(headers["warc-record-id"]), headers["warc-target-uri"], kind,
                        headers["warc-payload-digest"].removeprefix("sha1:"), _key(refers) if refers else None,
                        block if response else None,
                    ))
                columns = list(zip(*out))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [part.split()[0] for part in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    parts = max(1, -(-index.count() // settings.rows))
    near = index.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return near.mapInArrow(read, RECORD)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{run_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    records = read_records(index, folder)
    # The digest is that of the payload that was read; a revisit's size is its response's.
    facts = cut_lineage(records.select(
        "key", "record_type", "refers_to", "digest", "payload_bytes", F.sha1("payload").alias("read_sha1")
    ))
    responses, revisits = facts.where("record_type = 'response'"), facts.where("record_type = 'revisit'")
    sizes = responses.select(F.col("key").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    found = revisits.join(sizes, "refers_to", "left").withColumn("payload_bytes", F.col("full_bytes")).drop("full_bytes")
    return responses.unionByName(found).select(
        F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        "refers_to", "read_sha1",
    )
