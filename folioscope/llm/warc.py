"""Deterministic sharded WARC 1.1 writer and reader.

Pages are cut into shards by page_id ranges whose borders come from a byte histogram of the ids, so
equal input gives equal shards whatever the cluster. A shard is sorted, each record becomes a gzip
member of its own, and files roll when their compressed size passes a limit; a file that no shard
range can split (one id holding most bytes) still rolls. Headers, record ids, dates and digests are
derived from the record alone. A task writes under a temporary name, closes, then moves the file to
its final name, which a retried or second attempt would fill with the same bytes. The driver commits
the archive last, by writing a manifest of (file, records, bytes, sha256); readers take only files
that a manifest names, and check them against it.

Records whose payload of at least ``revisit_bytes`` equals that of a smaller page_id become
``revisit`` records without payload. The digests are grouped with partial aggregation, and the way
back to the pages is a join of which Spark splits the skewed side.

Edge cases: a null html is an empty payload; a null url leaves out the target header. Rows that
repeat the smallest page_id of a payload are all responses. A null page_id sorts first, as the
smallest, and is read back as null. Control characters in a url are percent-encoded. An empty table
gives an archive without files. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import Rows, Scratch, rows_of, shuffle_partitions

LINE = b"\r\n"


@dataclass(frozen=True)
class WarcParams:
    file_bytes: int = 16 << 20  # compressed size at which a file rolls; 1 GB is usual at scale
    shard_bytes: int = 32 << 20  # payload bytes of a shard, about
    revisit_bytes: int = 100
    date: str = "2020-01-01T00:00:00Z"  # a parameter, as a clock would break determinism
    level: int = 6


def safe_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_uuid(page_id: int | None, digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, params: WarcParams) -> bytes:
    """One WARC record; the HTTP head of a revisit still states the payload's length."""
    head = LINE.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{record_uuid(page_id, digest)}>"),
        ("WARC-Date", params.date),
        *([("WARC-Target-URI", safe_url(url))] if url is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([("X-Page-Id", str(page_id))] if page_id is not None else []),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{record_uuid(refers_to, digest)}>"),
            *([("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []),
        ]
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode() + block + LINE * 2


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of every record of one compressed file."""
    view, at, step = memoryview(data), 0, 64 << 10
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof and at < len(view):
            fed = view[at : at + step]
            parts.append(member.decompress(fed))
            at += len(fed) - len(member.unused_data)
        if not member.eof:
            raise ValueError("a WARC record is cut off")
        record = b"".join(parts)
        head, _, block = record.partition(LINE * 2)
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = block[: int(fields["Content-Length"])]
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
        http, _, payload = block.partition(LINE * 2)
        yield fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def with_revisits(pages: DataFrame, scratch: Scratch, params: WarcParams) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to, revisit."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload"))
    # the first id by (null first, then value); struct order puts false before true
    first = F.min(F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("page_id"))).alias("first")
    groups = base.where(F.col("n_bytes") >= params.revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), first).where("n > 1")
    groups = scratch.keep(groups.select("digest", F.col("first.page_id").alias("refers_to"), F.lit(True).alias("grouped")), "groups")
    revisit = F.coalesce(F.col("grouped"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return base.join(groups, "digest", "left").withColumn("revisit", revisit).drop("grouped")


def shard_borders(pages: DataFrame, params: WarcParams) -> list[int]:
    """First page_id of every shard but the first, from a histogram of bytes over id cells."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + 600
    span = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum(size).alias("b")).first()
    if span["low"] is None:
        return []
    shards = max(1, -(-span["b"] // params.shard_bytes))
    width = max(1, -(-(span["high"] - span["low"] + 1) // (16 * shards)))
    cell = F.floor((F.col("page_id") - span["low"]) / width)
    borders, held = [], 0
    for row in sorted(pages.where("page_id is not null").groupBy(cell.alias("cell")).agg(F.sum(size).alias("b")).collect()):
        if held and held + row["b"] > params.shard_bytes:
            borders.append(span["low"] + row["cell"] * width)
            held = 0
        held += row["b"]
    return borders


MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Writes the archive under ``folder`` and returns its manifest, read back from there."""
    scratch = Scratch(spark, "warc")
    borders = shard_borders(pages, params)
    shards = len(borders) + 1
    cuts = np.array(borders, np.int64)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype("int32"))

    out = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(f"{root}/data", recursive=True)
        store.create_dir(f"{root}/_temporary", recursive=True)
        made = Rows(MANIFEST)
        state: dict = {"shard": None}

        def close() -> None:
            if state.get("stream") is None:
                return
            state["stream"].close()
            name = f"shard-{state['shard']:06d}-{state['roll']:05d}.warc.gz"
            store.move(state["temporary"], f"{root}/data/{name}")  # replaces what an earlier attempt left
            made.add((name, state["records"], state["bytes"], state["digest"].hexdigest()))
            state["stream"] = None
            state["roll"] += 1

        for number, page_id, url, payload, digest, refers_to, revisit in rows_of(batches, "shard", "page_id", "url", "payload", "digest", "refers_to", "revisit", at_once=100):
            if number != state["shard"]:
                close()
                state = {"shard": number, "roll": 0, "stream": None}
            member = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to, revisit, params), params.level, mtime=0)
            if state["stream"] is not None and state["bytes"] + len(member) > params.file_bytes:
                close()
            if state["stream"] is None:
                temporary = f"{root}/_temporary/{uuid.uuid4().hex}"
                state |= {"stream": store.open_output_stream(temporary, compression=None), "temporary": temporary, "records": 0, "bytes": 0, "digest": hashlib.sha256()}
            state["stream"].write(member)
            state["digest"].update(member)
            state["records"] += 1
            state["bytes"] += len(member)
        close()
        if last := made.flush():
            yield last

    lowest = F.lit(-(2**63))
    ready = with_revisits(pages, scratch, params).withColumn("shard", shard(F.coalesce(F.col("page_id"), lowest)))
    manifest = (
        ready.repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "page_id", "url", "digest")
        .select("shard", "page_id", "url", "payload", "digest", "refers_to", "revisit")
        .mapInArrow(run, "file string, records long, bytes long, sha256 string")
    )
    manifest.write.parquet(f"{out}/manifest")
    scratch.delete(f"{out}/_temporary")
    return spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{out}/manifest")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    Only files that the manifest names are read, and each must have its length and SHA-256.
    Of a revisit, length and digest are those of the full payload; its payload is null.
    """
    out = folder.rstrip("/")
    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{out}/manifest")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        gathered = Rows(schema)
        for name, size, digest in rows_of(batches, "file", "bytes", "sha256"):
            with store.open_input_stream(f"{root}/data/{name}", compression=None) as stream:
                content = stream.read()
            if len(content) != size or hashlib.sha256(content).hexdigest() != digest:
                raise ValueError(f"{name} is not the file that the manifest names")
            for fields, http, payload in parse_records(content):
                revisit = fields["WARC-Type"] == "revisit"
                number = lambda key, f=fields: int(f[key]) if key in f else None
                if not revisit and f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
                    raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
                row = number("X-Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Type"], None if revisit else payload, int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), number("X-Refers-To-Page-Id")
                if full := gathered.add(row, len(payload) + 200):
                    yield full
        if last := gathered.flush():
            yield last

    return manifest.repartition(shuffle_partitions(spark), "file").mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
