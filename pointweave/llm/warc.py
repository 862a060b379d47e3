"""Operator 7: a deterministic sharded WARC writer, and its reader."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import cut, in_batches, small

#: Payload bytes of one shard (a range of ids) and compressed bytes at which a file is rolled.
SHARD_BYTES, ROLL_BYTES = 16 << 20, 4 << 20
#: Files that the driver renames at a time.
RENAMES = 32
#: Equal payloads of at least so many bytes are written once.
REVISIT_FROM = 0
#: Equal parts that an id range is cut into when it is too heavy for one shard.
SPLIT = 1024
WHEN = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "temp string, name string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def opened(uri: str, mode: str) -> BinaryIO:
    """A file in the shared store, from an executor: a mounted path, or any store that Arrow knows by its scheme."""
    if uri.startswith("file:") or "://" not in uri:
        path = re.sub(r"^file:(//)?", "", uri)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if mode == "wb" else store.open_input_stream(path)


def starts_of(slim: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """Ascending keys (id, payload hash) at which a new shard begins, so that shards hold about ``shard_bytes`` each.

    From exact sums over equal parts of the id range; a part that is too heavy is cut again, down to single ids, and
    an id of very many rows (null among them) by its payloads' hashes. One pass over ``slim`` per depth; what returns
    is bounded by the shards times SPLIT. Rows equal in id and payload are in one shard, whose task streams them.
    """
    parts: list[tuple[tuple[int, int], int]] = []

    def sift(rows: DataFrame, at: str, todo: list[tuple[int, int]], put) -> list[int]:
        """Sum up equal parts of the ranges ``todo`` (ends included); hand the light ones to ``put`` and return the places that are too heavy."""
        heavy = []
        while todo:
            found = F.array(*[F.struct(*(F.lit(v).cast("long").alias(n) for v, n in ((a, "a"), (z, "z"), (-(-(z - a + 1) // SPLIT), "w")))) for a, z in todo])
            inside = rows.withColumn("pw_r", F.explode(F.filter(found, lambda r: F.col(at).between(r["a"], r["z"]))))
            place = F.col(at).cast("decimal(20,0)")  # ids may span more than a long holds
            low = (place - (place - F.col("pw_r.a")) % F.col("pw_r.w")).cast("long")
            todo = []
            for r in inside.groupBy(low.alias("at"), "pw_r.w", "pw_r.z").agg(F.sum("payload_bytes").alias("n")).collect():
                if r["n"] <= shard_bytes:
                    put(r["at"], r["n"])
                elif r["w"] > 1:
                    todo.append((r["at"], min(r["at"] + r["w"] - 1, r["z"])))
                else:
                    heavy.append((r["at"], r["n"]))
        return heavy

    least, most = slim.agg(F.min("key"), F.max("key")).first()
    if least is None:
        return []
    for key, _ in sift(slim, "key", [(least, most)], lambda at, n: parts.append(((at, 0), n))):
        for place, n in sift(slim.where(F.col("key") == key), "part", [(0, (1 << 31) - 1)], lambda at, n, key=key: parts.append(((key, at), n))):
            parts.append(((key, place), n))
    starts, held = [], 0
    for at, n in sorted(parts):
        if held and held + n > shard_bytes:
            starts.append(at)
            held = 0
        held += n
    return starts


def shard_of(spark: SparkSession, starts: list[tuple[int, int]], key: Column, part: Column) -> Column:
    """The number of starts up to (key, part), looked up in a broadcast array of 16 bytes a shard."""
    table = spark.sparkContext.broadcast(np.array(starts, np.int64).reshape(-1, 2))

    @F.pandas_udf("int")
    def look_up(keys: pd.Series, places: pd.Series) -> pd.Series:
        at, x, y = table.value, keys.to_numpy(), places.to_numpy()
        low, high = np.searchsorted(at[:, 0], x, "left"), np.searchsorted(at[:, 0], x, "right")
        for k in np.unique(x[high > low]):
            same = x == k
            first, last = np.searchsorted(at[:, 0], k, "left"), np.searchsorted(at[:, 0], k, "right")
            high[same] = first + np.searchsorted(at[first:last, 1], y[same], "right")
        return pd.Series(np.maximum(low, high).astype(np.int32))

    return look_up(key, part)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def header_value(text: str) -> str:
    """Without the characters that would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def target_uri(page_id: int | None, url: str | None) -> str:
    return header_value(url or f"urn:page:{page_id}")


def record(row: dict, payload: bytes | None, digest: str) -> bytes:
    """One WARC record, headers and digests made anew; ``payload`` None makes a revisit of the page ``row["first"]``."""
    page_id, url, size, first = row["page_id"], row["url"], row["payload_bytes"], row["first"]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head + (payload or b"")
    again = [
        f"WARC-Profile: {PROFILE}",
        f"WARC-Refers-To: {record_id(first, row['first_url'], digest)}",
        f"WARC-Refers-To-Target-URI: {target_uri(first, row['first_url'])}",
        f"WARC-Refers-To-Date: {WHEN}",
        f"X-Refers-To-Page: {first}",
    ]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {WHEN}",
        f"WARC-Target-URI: {target_uri(page_id, url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *(again if payload is None else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *(["X-No-Url: 1"] if url is None else []),
        f"X-Payload-Bytes: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_info(name: str) -> bytes:
    """The warcinfo record that opens a file."""
    block = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    lines = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {WHEN}",
        f"WARC-Filename: {name}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    """A gzip member without a time, the same on each run."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roller:
    """Writes the records of one shard to numbered files under temporary names."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.folder, self.shard, self.roll_bytes, self.number, self.file = folder, shard, roll_bytes, 0, None

    def add(self, member: bytes) -> Iterator[tuple]:
        if self.file and self.size + len(member) > self.roll_bytes:
            yield self.close()
        if not self.file:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.file, self.size, self.records, self.sha = opened(f"{self.folder}/{self.temp}", "wb"), 0, 0, hashlib.sha256()
            self.put(gzipped(file_info(self.name)))
        self.put(member)
        self.records += 1

    def put(self, member: bytes) -> None:
        self.file.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> tuple:
        self.file.close()
        self.file, self.number = None, self.number + 1
        return self.temp, self.name, self.records, self.size, self.sha.hexdigest()


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_from: int = REVISIT_FROM, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row under ``folder`` and return the manifest (name, records, bytes, sha256).

    Ids are cut into ranges by their payload bytes; a range is sorted by id, digest and url and written by one task in
    files of ``roll_bytes``. Tasks write under names of their own; the driver renames the files of the attempts that
    count and writes the manifest last, so a folder without a manifest holds nothing. The same rows give the same
    files on any number of executors. Of equal payloads the one with the least id is a response, the others are
    revisits; rows that share that id and payload are all responses, and so are all rows of a payload without any id.
    Null html is an empty payload; rows with a null id come first; an empty table gives an empty manifest. Ids are
    integers, or texts of integers (others raise); other columns are not read.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("sha1"))
    part = F.conv(F.substring("sha1", 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << 31) - 1))
    slim = cut(rows.select("page_id", "url", "payload_bytes", "sha1", part.alias("part")), "warc-rows")
    first_id = slim.agg(F.min("page_id")).first()[0]
    key = F.coalesce(F.col("page_id"), F.lit(0 if first_id is None else max(first_id - 1, -(1 << 63))).cast("long"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("least")
    twins = slim.where(F.col("payload_bytes") >= revisit_from).groupBy("sha1", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), least).where("n > 1")
    twins = cut(twins.select("sha1", "payload_bytes", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url")), "warc-twins")
    starts = starts_of(slim.select(key.alias("key"), "part", "payload_bytes"), shard_bytes)
    linked = rows.join(small(twins, 48), ["sha1", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    linked = linked.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "sha1", F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))
    dealt = linked.withColumn("shard", shard_of(spark, starts, key, part)).repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", part, "sha1", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple]:
            roller = None
            for b in batches:
                for r in b.to_pylist():
                    if roller is None or roller.shard != r["shard"]:
                        if roller:
                            yield roller.close()
                        roller = Roller(folder, r["shard"], roll_bytes)
                    payload = None if r["html"] is None else r["html"].encode()
                    yield from roller.add(gzipped(record(r, payload, base32(r["sha1"]))))
            if roller:
                yield roller.close()

        for f in files():
            yield pa.RecordBatch.from_pylist([dict(zip(("temp", "name", "records", "bytes", "sha256"), f, strict=True))])

    manifest = cut(in_batches(dealt, run, MANIFEST, 256), "warc-written")
    commit(spark, folder, manifest)
    return spark.read.schema(manifest.drop("temp").schema).parquet(f"{folder}/manifest")


def commit(spark: SparkSession, folder: str, manifest: DataFrame) -> None:
    """Rename what the manifest names, drop other attempts' files, write the manifest: from then on the files count."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(r) -> str | None:
        return None if store.rename(path(f"{folder}/{r['temp']}"), path(f"{folder}/{r['name']}")) else r["name"]

    with ThreadPoolExecutor(RENAMES) as pool:
        lost = [name for name in pool.map(put, manifest.select("temp", "name").toLocalIterator()) if name]
    if lost:
        raise OSError(f"{len(lost)} files could not be put in place, {lost[0]} among them")
    store.delete(path(f"{folder}/_temporary"), True)
    manifest.drop("temp").write.parquet(f"{folder}/manifest")


class Read:
    """A file that counts and hashes what is read of it."""

    def __init__(self, file: BinaryIO):
        self.file, self.size, self.sha = file, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.file.read(n)
        self.size += len(data)
        self.sha.update(data)
        return data


def members(file: BinaryIO | Read) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    z, out, begun = zlib.decompressobj(31), [], False
    while data := file.read(1 << 20):
        while data:
            out.append(z.decompress(data))
            begun, data = True, z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("an archive ends inside a record")


def parsed(member: bytes) -> dict | None:
    """A RECORD of a response or revisit, digests checked; None for records that describe the file."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"{fields['WARC-Record-ID']}: the block differs from its digest")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page", "X-Payload-Bytes")}
    url = None if "X-No-Url" in fields else fields["WARC-Target-URI"]
    return {"page_id": number["X-Page-Id"], "url": url, "payload_bytes": number["X-Payload-Bytes"] if revisit else len(payload), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number["X-Refers-To-Page"], "payload": payload}


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of the files that the manifest under ``folder`` names; a task streams a file.

    The digest of each block and the size, record count and digest of each file must be the manifest's, else the read
    fails: a missing, cut or changed file gives no rows in silence.
    """
    manifest = spark.read.schema("name string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    schema = RECORD if payloads else RECORD.rpartition(", ")[0]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split(" ")[1]]) for n, f in zip(names, schema.split(", "), strict=True)])

    def rows_of(entry: dict) -> Iterator[pa.RecordBatch]:
        rows, held, records = [], 0, 0
        with opened(f"{folder}/{entry['name']}", "rb") as raw:
            file = Read(raw)
            for member in members(file):
                got = parsed(member)
                if got is None:
                    continue
                records += 1
                rows.append({k: v for k, v in got.items() if k in names})
                held += len(member) if payloads else 64
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
        if (records, file.size, file.sha.hexdigest()) != (entry["records"], entry["bytes"], entry["sha256"]):
            raise ValueError(f"{entry['name']}: {records} records in {file.size} bytes are not what the manifest says")
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entry in b.to_pylist():
                yield from rows_of(entry)

    files = max(1, min(4096, manifest.count()))
    return manifest.repartition(files).mapInArrow(run, schema)
