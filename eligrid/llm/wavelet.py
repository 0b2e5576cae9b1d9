"""Token-id output as one wavelet matrix per shard.

Ids of consecutive documents (ascending doc_id) form one file: bit planes of a wavelet matrix with a rank directory,
each section compressed by itself, and the document boundaries. A reader answers access, count, rank and occurrence
lookups from that file alone, plane by plane, without unpacking the ids; `decode` gives all ids back.

The table is range-partitioned and sorted by doc_id; each task streams its rows into files of bounded size, written
under a temporary name and renamed, so a repeated task only replaces its own files. The written manifest is the
commit: files it does not name do not count.

Defined results: a null or empty text holds only the end id. Null doc_ids come first; repeated doc_ids follow each
other by text. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligrid.llm.common import scratch, shared_files
from eligrid.llm.tokens import encoder

MAGIC = b"WVMX1\n"
# Ids of one file, and so what a task holds; a longer document fills a file of its own.
FILE_IDS = 1 << 21
RANK_BITS = 512

MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, n_bytes long, sha256 string"


def _narrow(bits):
    """The smallest unsigned type for ids of so many bits: every plane moves all ids once."""
    import numpy as np

    return np.uint16 if bits <= 16 else np.uint32


class WaveletMatrix:
    """Bit planes from the highest bit down; each plane lists zeros before ones for the next."""

    def __init__(self, n, planes, zeros):
        self.n, self.planes, self.zeros = n, planes, zeros  # planes: (packed bits, rank directory)

    @classmethod
    def build(cls, ids, bits):
        import numpy as np

        planes, zeros = [], []
        ids = np.asarray(ids, _narrow(bits))
        words = RANK_BITS // 64
        for level in range(bits - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            # Whole words of 64 bits are counted; zeros fill up the last block.
            filled = np.zeros(-(-len(packed) * 8 // RANK_BITS) * words, "<u8")
            filled.view(np.uint8)[: len(packed)] = packed
            blocks = np.bitwise_count(filled).reshape(-1, words).sum(axis=1, dtype=np.int64)
            planes.append((packed, np.concatenate(([0], np.cumsum(blocks))).astype("<u4")))
            low = ids.compress(~bit)
            zeros.append(len(low))
            ids = np.concatenate((low, ids.compress(bit)))
        return cls(len(ids), planes, zeros)

    def _ones(self, level, i):
        """Ones before position i."""
        packed, ranks = self.planes[level]
        block, byte = i // RANK_BITS, i // 8
        ones = int(ranks[block]) + int.from_bytes(packed[block * RANK_BITS // 8 : byte].tobytes(), "little").bit_count()
        return ones + (int(packed[byte]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def _bit(self, level, i):
        return (int(self.planes[level][0][i // 8]) >> (i % 8)) & 1

    def _select(self, level, bit, k):
        """Position of the k-th (from 0) one or zero, by bisection over ranks."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i):
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, symbol, i):
        low, high = 0, i
        if symbol >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, symbol, i):
        """Occurrences of symbol before position i."""
        low, high = self._range(symbol, i)
        return high - low

    def count(self, symbol):
        return self.rank(symbol, self.n)

    def select(self, symbol, k):
        """Position of the k-th (from 0) occurrence."""
        low, high = self._range(symbol, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = symbol >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self):
        """All ids in order, from the lowest plane up."""
        import numpy as np

        # The last plane's successor lists equal ids together; rebuild upwards by undoing the partitions.
        depth = len(self.zeros)
        ids = np.zeros(self.n, _narrow(depth))
        for level in range(depth - 1, -1, -1):
            bit = np.unpackbits(self.planes[level][0], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(ids)
            up[np.flatnonzero(~bit)] = ids[: self.zeros[level]]
            up[np.flatnonzero(bit)] = ids[self.zeros[level] :] | ids.dtype.type(1 << (depth - 1 - level))
            ids = up
        return ids.astype(np.uint32)


def dump(ids, doc_ids, lengths, bits) -> bytes:
    """The file's bytes: magic, header length, header, compressed sections."""
    import json
    import struct

    import numpy as np
    import zstandard

    matrix = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    sections = [pack(np.asarray(lengths, "<i8").tobytes())]
    for packed, ranks in matrix.planes:
        sections += [pack(packed.tobytes()), pack(ranks.tobytes())]
    header = json.dumps(
        {"n": matrix.n, "bits": bits, "zeros": matrix.zeros, "docs": doc_ids, "sections": [len(s) for s in sections]}
    ).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(sections)


def parse(data: bytes):
    """(matrix, doc ids, lengths) of a file's bytes."""
    import json
    import struct

    import numpy as np
    import zstandard

    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet file")
    at = len(MAGIC) + 4
    size = struct.unpack("<I", data[at - 4 : at])[0]
    header = json.loads(data[at : at + size])
    at += size
    unpack = zstandard.ZstdDecompressor().decompress
    parts = []
    for length in header["sections"]:
        parts.append(unpack(data[at : at + length]))
        at += length
    lengths = np.frombuffer(parts[0], "<i8")
    planes = [(np.frombuffer(parts[i], np.uint8), np.frombuffer(parts[i + 1], "<u4")) for i in range(1, len(parts), 2)]
    return WaveletMatrix(header["n"], planes, header["zeros"]), header["docs"], lengths


def _writer(folder, path, keeps_blanks, end_id, bits, file_ids):
    def run(batches):
        import hashlib
        import struct
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = shared_files(folder)
        fs.create_dir(root, recursive=True)
        encode, end = encoder(path, keeps_blanks).encode, struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        docs, chunks, state = [], [], {"seq": 0, "ids": 0}

        def flush():
            ids = np.frombuffer(b"".join(chunks), "<u4")
            data = dump(ids, docs, [len(c) // 4 for c in chunks], bits)
            name = f"part-{part:06d}-{state['seq']:06d}.wvm"
            temporary = f"{root}/_{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temporary) as out:
                out.write(data)
            fs.move(temporary, f"{root}/{name}")
            row = (part, state["seq"], name, len(docs), len(ids), len(data), hashlib.sha256(data).hexdigest())
            docs.clear()
            chunks.clear()
            state.update(seq=state["seq"] + 1, ids=0)
            return pa.RecordBatch.from_pydict(
                {n: [v] for n, v in zip(("part", "seq", "file", "n_docs", "n_ids", "n_bytes", "sha256"), row)},
                schema=pa.schema(
                    [("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]
                ),
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                if chunks and state["ids"] + len(ids) // 4 > file_ids:
                    yield flush()
                docs.append(doc_id.as_py())
                chunks.append(ids)
                state["ids"] += len(ids) // 4
        if chunks:
            yield flush()

    return run


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    vocabulary: int,
    keeps_blanks: bool = True,
    end_id: int = 2,
    file_ids: int = FILE_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[str, DataFrame]:
    """Write all documents; returns the folder and the manifest, with the ids before each file in `start`."""
    spark = docs.sparkSession
    folder = scratch(spark, "wavelet")
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    bits = max(1, (max(vocabulary - 1, end_id)).bit_length())
    files = ordered.mapInArrow(_writer(f"{folder}/files", tokenizer, keeps_blanks, end_id, bits, file_ids), MANIFEST)
    files.write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(files.schema).parquet(f"{folder}/manifest")
    # Starts in two levels: one row per writing task, then the files of a task.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.join(parts, "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return folder, manifest.drop("part_start")


def _reader(folder):
    def run(batches):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        fs, root = shared_files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{row['file']}") as source:
                    data = source.read()
                if hashlib.sha256(data).hexdigest() != row["sha256"]:
                    raise OSError(f"{row['file']} differs from its manifest")
                matrix, docs, lengths = parse(data)
                ids = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(starts + row["start"], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(ids[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_documents(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    # A given number keeps the few small rows from being coalesced into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("file", "sha256", "start").repartition(tasks, "file")
    return spread.mapInArrow(_reader(f"{folder}/files"), "doc_id long, start long, n_tokens long, ids_crc32 long")
