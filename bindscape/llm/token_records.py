"""Token ids as length-delimited binary records, with a separate offset index.

Texts are encoded in id order and written as shards. A record is

    length of the body, u64 | masked crc32 of these 8 bytes, u32 | body | masked crc32 of the body, u32

with the body ``id i64 | id is null u8 | bytes per token u8 | count u32 | tokens u16 or u32``, all little-endian.
The mask rotates the checksum by 15 bits and adds a constant, so that a checksum of data that holds checksums
does not cancel out. Tokens take two bytes each while the vocabulary fits.

The index is a Parquet table (doc_id, shard, file, offset, size, start_in_shard, n_tokens). Any reader can
pick records by it in any order. A task writes its shard under a name of its own and the index names only the
files of tasks that Spark committed, so a lost executor or a second attempt leaves no wrong reference.

Null text counts as empty: the record holds the end id alone. Null ids sort first; rows with equal ids keep
a record each, ordered by their text. An empty table gives an empty index and no shards. A record holds a whole text,
however long, up to 2^32 tokens. Only the two columns named are read, whatever else the table holds.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe_automaton import byte_alphabet, default_path, word_split

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qBBI")
TAIL = struct.Struct("<I")
INDEX = "doc_id long, shard int, file string, offset long, size long, start_in_shard long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    body = BODY.pack(doc_id or 0, doc_id is None, 4 if wide else 2, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = len(body).to_bytes(8, "little")
    return size + TAIL.pack(masked(size)) + body + TAIL.pack(masked(body))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    size, check = HEAD.unpack_from(record)
    body = record[HEAD.size : HEAD.size + size]
    if masked(record[:8]) != check or len(body) != size or masked(body) != TAIL.unpack_from(record, HEAD.size + size)[0]:
        raise ValueError("a record's checksum does not match")
    doc_id, is_null, width, n = BODY.unpack_from(body)
    return (None if is_null else doc_id), np.frombuffer(body, "<u4" if width == 4 else "<u2", n, BODY.size)


class LibraryEncoder:
    """Ids of whole texts from the tokenizers library.

    The library splits a text into words and runs its model on each by itself, so the ids of a word can be kept
    and only new words go to its model. Texts that hold a special token go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = word_split()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 1 << 16
        run, shown = self.library.model.tokenize, {b: ord(c) for c, b in byte_alphabet().items()}
        self.type = np.dtype("<u4" if self.wide else "<u2")
        kind = "I" if self.wide else "H"
        self.memo = common.Memo(lambda w: array(kind, [t.id for t in run((w if w.isascii() else w.encode().decode("latin-1")).translate(shown))]).tobytes(), 1_000_000)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.words.findall(text))), self.type)


def library_encoder(path: str) -> LibraryEncoder:
    return common.held(("records", path), lambda: LibraryEncoder(path))


def write_records(docs: DataFrame, path: str, end_id: int | None = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards in rising order of ids and return the committed index. One shuffle, by id range."""
    spark = docs.sparkSession
    folder = folder or common.shared_dir(spark, "token-records")
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard = None, TaskContext.get().partitionId()
        sink, file, offset, start = None, "", 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                encoder = library_encoder(path)
                store, at = fs.FileSystem.from_uri(folder)
                store.create_dir(at, recursive=True)
                file = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
                sink = store.open_output_stream(f"{at}/{file}")
            rows = {k: [] for k in ("offset", "size", "start_in_shard", "n_tokens")}
            step = 256
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                for doc_id, ids in zip(part.column(0).to_pylist(), map(encoder.encode, part.column(1).to_pylist()), strict=True):
                    if end_id is not None:
                        ids = np.append(ids, encoder.type.type(end_id))
                    record = frame(doc_id, ids, encoder.wide)
                    sink.write(record)
                    for name, value in zip(rows, (offset, len(record), start, len(ids)), strict=True):
                        rows[name].append(value)
                    offset, start = offset + len(record), start + len(ids)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shard] * n, pa.int32()), pa.array([file] * n), *(pa.array(v, pa.int64()) for v in rows.values())], names=["doc_id", "shard", "file", *rows])
        if sink is not None:
            sink.close()

    index = ordered.mapInArrow(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def read_records(index: DataFrame) -> DataFrame:
    """(doc_id, shard, start_in_shard, ids) of the records that the rows of an index name, checked. ids: u32 little-endian bytes."""
    schema = "doc_id long, shard int, start_in_shard long, ids binary"

    def read(batches):
        from pyarrow import fs

        name, source = None, None
        for batch in batches:
            d = batch.to_pydict()
            for k in range(0, batch.num_rows, 512):
                ids = []
                for folder, file, offset, size, doc_id in zip(*(d[c][k : k + 512] for c in ("folder", "file", "offset", "size", "doc_id")), strict=True):
                    if (folder, file) != name:
                        store, at = fs.FileSystem.from_uri(folder)
                        name, source = (folder, file), store.open_input_file(f"{at}/{file}")
                    got, tokens = unframe(source.read_at(size, offset))
                    if got != doc_id:
                        raise ValueError(f"record of {got} where the index has {doc_id}")
                    ids.append(tokens.astype("<u4").tobytes())
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("shard"), part.column("start_in_shard"), pa.array(ids, pa.binary())], names=["doc_id", "shard", "start_in_shard", "ids"])

    return index.mapInArrow(read, schema)


def with_starts(index: DataFrame) -> DataFrame:
    """Add start: tokens in all records before. The driver gets one sum for each shard, never rows of documents."""
    spark = index.sparkSession
    sums = sorted((r["shard"], r["n"]) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    base, rows = 0, []
    for shard, n in sums:
        rows.append((shard, base))
        base += n
    bases = spark.createDataFrame(rows, "shard int, base long")
    return index.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = with_starts(write_records(common.table(spark, sf_dir, "documents"), default_path()))
    starts = index.groupBy("shard").agg(F.min("start").alias("base"))
    back = read_records(index.drop("start")).join(F.broadcast(starts), "shard")
    return back.select(
        "doc_id",
        (F.col("base") + F.col("start_in_shard")).alias("start"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
