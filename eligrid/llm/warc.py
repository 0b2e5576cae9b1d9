"""WARC writer: deterministic shards, rolled by compressed size, committed by renames and a manifest.

Shards are page_id ranges whose limits come from a bottom-k sample by hash, so they depend on the rows alone and not
on how Spark splits them; records are sorted inside. A task streams one shard into gzip files (one member per
record), regenerates every header and digest, writes each file under a temporary name and renames it when complete:
a repeated task replaces its own files with equal ones. The written manifest is the commit; the reader opens only
files it names and checks their digests.

Of records with equal payloads of at least `least_bytes`, the one with the smallest page_id is the response and the
others revisit it (identical-payload-digest, no payload stored); smaller payloads are always responses.

Defined results: null html is an empty payload; null urls leave the target header out; null page_ids come first, are
never revisited while another page_id has the payload, and rows that repeat page_id and payload share their type but
not their record id, which counts them in the order of their urls; revisits refer to the first. An empty
table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid.llm.common import scratch, shared_files

# Payload bytes aimed at per shard, compressed bytes at which a file is closed, ids sampled for the limits.
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
SAMPLE_IDS = 16_384
DATE = "2020-01-01T00:00:00Z"

MANIFEST = "shard int, seq int, file string, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def record_rows(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, digest, mark, url, payload, size, refers_to): pages, and a mark before each page that is a revisit.

    Narrow rows decide what revisits what, equal payloads combined before the shuffle. The decision is not joined to
    the payloads: it travels as a row of its own that sorts just before its page, so payloads are shuffled once.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.filter(F.col("size") >= least_bytes).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    again = large.join(firsts, "digest").filter("page_id IS NULL OR page_id > first").distinct()
    none = F.lit(None)
    marks = again.select("page_id", "digest", F.lit(0).alias("mark"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), none.cast("long").alias("size"), F.col("first").alias("refers_to"))
    return rows.select("page_id", "digest", F.lit(1).alias("mark"), "url", "payload", "size", none.cast("long").alias("refers_to")).union(marks)


def range_limits(df: DataFrame, key: str, parts: int, sample: int = SAMPLE_IDS) -> list:
    """Upper limits of `parts` ranges of about equal row counts; a function of the set of keys alone."""
    keys = df.select(F.col(key).alias("k")).filter("k IS NOT NULL")
    ids = sorted({r["k"] for r in keys.select("k", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(sample).collect()})
    return sorted({ids[len(ids) * i // parts] for i in range(1, parts)}) if ids else []


def _writer(folder, roll_bytes):
    def run(batches):
        import hashlib
        import uuid
        import zlib

        import pyarrow as pa

        fs, root = shared_files(folder)
        fs.create_dir(root, recursive=True)
        state = {"out": None, "shard": None, "seq": 0}

        def member(data):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            return pack.compress(data) + pack.flush()

        def name_of(page_id, digest, repeat=0):
            key = f"{page_id}:{digest}:{repeat}" if repeat else f"{page_id}:{digest}"
            return "<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_OID, key)) + ">"

        def record(kind, headers, block):
            lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None)]
            lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
            return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

        def begin(shard):
            if state["shard"] != shard:
                state.update(shard=shard, seq=0)
            name = f"shard-{shard:06d}-{state['seq']:05d}.warc.gz"
            temporary = f"{root}/_{uuid.uuid4().hex}.tmp"
            state.update(name=name, temporary=temporary, out=fs.open_output_stream(temporary, compression=None), records=0, bytes=0, sha=hashlib.sha256())
            info = b"software: eligrid\r\nformat: WARC File Format 1.1\r\n"
            put(record("warcinfo", [("WARC-Record-ID", name_of(name, "")), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

        def put(data):
            data = member(data)
            state["out"].write(data)
            state["bytes"] += len(data)
            state["sha"].update(data)

        def finish():
            state["out"].close()
            fs.move(state["temporary"], f"{root}/{state['name']}")
            row = (state["shard"], state["seq"], state["name"], state["records"], state["bytes"], state["sha"].hexdigest())
            state.update(out=None, seq=state["seq"] + 1)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["shard", "seq", "file", "n_records", "n_bytes", "sha256"])

        revisit, same, repeat = (None, None, None), None, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "page_id", "digest", "mark", "url", "size", "refers_to", "payload")]
            for *values, payload in zip(*columns):
                shard, page_id, digest, mark, url, size, refers = (x.as_py() for x in values)
                if not mark:
                    revisit = (page_id, digest, refers)
                    continue
                refers = revisit[2] if revisit[:2] == (page_id, digest) else None
                repeat = repeat + 1 if same == (page_id, digest) else 0
                same = (page_id, digest)
                if state["out"] and (state["shard"] != shard or state["bytes"] >= roll_bytes):
                    yield finish()
                if not state["out"]:
                    begin(shard)
                target = None if url is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                headers = [
                    ("WARC-Record-ID", name_of(page_id, digest, repeat)),
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", target),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("WARC-Payload-Digest", f"sha256:{digest}"),
                    ("X-Page-ID", page_id),
                ]
                if refers is None:
                    put(record("response", headers, http + payload.as_py()))
                else:
                    headers += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", name_of(refers, digest)),
                        ("X-Refers-To-Page-ID", refers),
                    ]
                    put(record("revisit", headers, http))
                state["records"] += 1
        if state["out"]:
            yield finish()

    return run


def write_archive(pages: DataFrame, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_bytes: int = 100) -> tuple[str, DataFrame]:
    """Write one record per row; returns the folder and the manifest."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).collect()[0][0]
    shards = max(1, -(-total // shard_bytes))
    limits = range_limits(pages, "page_id", shards) if shards > 1 else []
    parts = len(limits) + 1

    @F.pandas_udf("int")
    def shard_of(ids):
        import numpy as np
        import pandas as pd

        known = ids.notna().to_numpy()
        at = np.zeros(len(ids), np.int32)
        at[known] = np.searchsorted(np.array(limits, np.int64), ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(at)

    rows = record_rows(pages, least_bytes).withColumn("shard", shard_of("page_id") if limits else F.lit(0))
    ordered = rows.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "mark", "url")
    files = ordered.mapInArrow(_writer(f"{folder}/files", roll_bytes), MANIFEST)
    files.write.parquet(f"{folder}/manifest")
    return folder, spark.read.schema(files.schema).parquet(f"{folder}/manifest")


def members(source, chunk=1 << 20):
    """The unpacked gzip members of a stream, one at a time."""
    import zlib

    rest, unpack, out = b"", None, []
    while True:
        data = rest or source.read(chunk)
        if not data:
            if unpack is not None:
                raise EOFError("a gzip member is cut off")
            return
        if unpack is None:
            unpack, out = zlib.decompressobj(31), []
        out.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack = None


def parse_record(data):
    """(type, headers with lower-case names, block) of one record; digests and lengths are checked."""
    import hashlib

    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(headers["content-length"])
    block = body[:length]
    if len(block) != length or headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("damaged record " + headers.get("warc-record-id", ""))
    return headers["warc-type"], headers, block


def _reader(folder):
    def run(batches):
        import hashlib

        import pyarrow as pa

        fs, root = shared_files(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")

        def number(text):
            return None if text is None else int(text)

        for batch in batches:
            for entry in batch.to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{entry['file']}", compression=None) as source:
                    for data in members(source):
                        kind, headers, block = parse_record(data)
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError("damaged payload of " + headers["warc-record-id"])
                        rows.append((number(headers.get("x-page-id")), size, digest, kind, number(headers.get("x-refers-to-page-id")), headers.get("warc-target-uri")))
                if len(rows) != entry["n_records"]:
                    raise OSError(f"{entry['file']} differs from its manifest")
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)], names)

    return run


def read_archive(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record, from the archives alone."""
    # A given number keeps the few small rows from being coalesced into one task.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("file", "n_records").repartition(tasks, "file")
    return spread.mapInArrow(_reader(f"{folder}/files"), RECORDS)
