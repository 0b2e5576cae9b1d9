"""Packing token sequences: harmonic classes of reciprocals of the capacity.

`pack_documents` keeps documents whole. Ids beyond the capacity C leave as full sequences; what remains of a document,
at most C ids, is one piece. Pieces longer than C/(k+1) and at most C/k form class k, and every bin of the class takes
exactly k of them. The room they leave in a bin is filled from one document per task that is cut as it goes (the
filler; when it is used up the next document takes its place), so closed bins carry no padding.

`pack` cuts every document greedily into pieces of length C, C/2, C/4, ..., 1 (C a power of two), longest first, so
class k holds pieces of exactly C/2^k ids and every bin of the class takes exactly 2^k of them.

In both each task fills the bins of its own rows, no shuffle and no exchange between workers. What a task has left
goes to full bins and bins of power-of-two lengths, which need no padding either.

Defined results: a null or empty text is one document holding only its end id. Null and repeated doc_ids are packed
like others. An empty table gives no sequences. Pieces of one document are cut in order. Sequence ids are unique; they
depend on how the input is split into tasks, as do the cuts of `pack_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid.llm.tokens import encoder

SEQUENCES = "sequence_id long, n_ids int, ids binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint,doc_tokens:bigint>>"


def _packer(path, keeps_blanks, end_id, capacity, out_rows):
    def run(batches):
        import struct

        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path, keeps_blanks).encode
        end = struct.pack("<I", end_id)
        top = capacity.bit_length() - 1
        base = TaskContext.get().partitionId() << 36
        open_bins = [[] for _ in range(top + 1)]
        done, serial = [], [0]
        piece = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "offset", "doc_tokens")])

        def close(members):
            offset, pieces = 0, []
            for doc_id, start, ids, total in members:
                pieces.append({"doc_id": doc_id, "start": start, "length": len(ids) // 4, "offset": offset, "doc_tokens": total})
                offset += len(ids) // 4
            done.append((base + serial[0], offset, b"".join(m[2] for m in members), pieces))
            serial[0] += 1

        def batch_out():
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.list_(piece)))],
                ["sequence_id", "n_ids", "ids", "pieces"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total, start = len(ids) // 4, 0
                while start < total:
                    k = min(top, (total - start).bit_length() - 1)
                    length = 1 << k
                    bin_ = open_bins[k]
                    bin_.append((doc_id.as_py(), start, ids[start * 4 : (start + length) * 4], total))
                    if len(bin_) == capacity >> k:
                        close(bin_)
                        open_bins[k] = []
                    start += length
                if len(done) >= out_rows:
                    yield batch_out()
        for k, bin_ in enumerate(open_bins):
            while bin_:
                take = 1 << (len(bin_).bit_length() - 1)
                close(bin_[:take])
                bin_ = bin_[take:]
                if len(done) >= out_rows:
                    yield batch_out()
        if done:
            yield batch_out()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    keeps_blanks: bool = False,
    capacity: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Sequences: sequence_id, n_ids, ids (little-endian unsigned 32-bit) and the pieces they hold."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_packer(tokenizer, keeps_blanks, end_id, capacity, 256), SEQUENCES)


def _documents_packer(path, keeps_blanks, end_id, capacity, out_rows):
    def run(batches):
        import struct

        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path, keeps_blanks).encode
        end = struct.pack("<I", end_id)
        base = TaskContext.get().partitionId() << 36
        # Pieces are (doc_id, start, ids, ids of the document). Class -> its open bin; bins with all their pieces that
        # wait for the filler; the filler, a list of at most one piece.
        open_bins, waiting, filler = {}, [], []
        done, serial = [], 0
        piece = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "offset", "doc_tokens")])

        def length_of(members):
            return sum(len(m[2]) for m in members) // 4

        def cut(members, length):
            """Take exactly so many ids off the front of the members."""
            taken = []
            while length:
                doc_id, start, ids, total = members.pop(0)
                if len(ids) // 4 > length:
                    members.insert(0, (doc_id, start + length, ids[length * 4 :], total))
                    ids = ids[: length * 4]
                taken.append((doc_id, start, ids, total))
                length -= len(ids) // 4
            return taken

        def close(members):
            nonlocal serial
            offset, pieces = 0, []
            for doc_id, start, ids, total in members:
                pieces.append({"doc_id": doc_id, "start": start, "length": len(ids) // 4, "offset": offset, "doc_tokens": total})
                offset += len(ids) // 4
            done.append((base + serial, offset, b"".join(m[2] for m in members), pieces))
            serial += 1

        def batch_out():
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.list_(piece)))],
                ["sequence_id", "n_ids", "ids", "pieces"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id, ids = doc_id.as_py(), encode(text.as_py() or "") + end
                total, start = len(ids) // 4, 0
                while total - start > capacity:
                    close([(doc_id, start, ids[start * 4 : (start + capacity) * 4], total)])
                    start += capacity
                    if len(done) >= out_rows:
                        yield batch_out()
                whole = (doc_id, start, ids[start * 4 :], total)
                if not filler:
                    filler.append(whole)
                else:
                    k = capacity // (total - start)
                    bin_ = open_bins.setdefault(k, [])
                    bin_.append(whole)
                    if len(bin_) == k:
                        waiting.append(open_bins.pop(k))
                while waiting:
                    room = capacity - length_of(waiting[-1])
                    waiting[-1] += cut(filler, min(room, length_of(filler)))
                    if length_of(waiting[-1]) < capacity:
                        break
                    close(waiting.pop())
                if len(done) >= out_rows:
                    yield batch_out()
        left = [m for bin_ in (*waiting, *open_bins.values(), filler) for m in bin_]
        rest = length_of(left)
        while rest:
            length = min(capacity, 1 << (rest.bit_length() - 1))
            close(cut(left, length))
            rest -= length
            if len(done) >= out_rows:
                yield batch_out()
        if done:
            yield batch_out()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    keeps_blanks: bool = False,
    capacity: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Sequences as `pack` gives them, by classes of whole documents."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_documents_packer(tokenizer, keeps_blanks, end_id, capacity, 256), SEQUENCES)


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece with the checksum of its ids, cut out of the sequence that holds it."""
    each = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    return each.select(
        F.col("p.doc_id").alias("doc_id"),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.crc32(F.substring("ids", F.col("p.offset").cast("int") * 4 + 1, F.col("p.length").cast("int") * 4)).alias("ids_crc32"),
        F.col("p.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        F.col("p.offset").alias("offset"),
    )
