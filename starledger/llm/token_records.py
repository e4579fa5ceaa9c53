"""Token ids in length-delimited binary records, with an offset index.

A shard file is a row of records; a record is

    length   8 bytes   little-endian length of the payload
    check    4 bytes   masked CRC-32 of the 8 length bytes
    payload  length    token ids, little-endian, 2 bytes each (4 if the vocabulary needs it)
    check    4 bytes   masked CRC-32 of the payload

A checksum is masked by turning it right by 15 bits and adding 0xA282EAD8, so that checksums
of data which hold checksums stay sound. CRC-32 is zlib's. Beside the shards lies an index in
Parquet: doc_id, shard, offset and length of the record, n_tokens, and start, the number of
ids in all documents before it, so that any record is read by one seek in any order.

Documents are dealt by ranges of doc_id and a hash of the text, so that the rows of one id can
be more than one shard, sorted within a range and written by one task a range. A shard appears
under its name by a rename once it is whole, so a task that is lost or run twice leaves one
whole shard; drafts of tasks that were cut off are removed at the end. The index is the folder
``index`` beside the shards, and ``open_index`` reads it.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clash_free, cuts, discard, per_batch, scratch, starts_of, stored_at, texts

#: Mask of the checksums, end id of the contract.
MASK_DELTA = 0xA282EAD8
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a Python worker remembers.
MEMORY = 250_000
#: Letters below U+0180 but the dotted capital I, whose lower case is two letters; marks that end words.
LATIN = [c for c in range(0x41, 0x180) if chr(c).isalpha() and c != 0x130]
LATIN_WORD = re.compile("[" + "".join(map(chr, LATIN)) + "]+")
MARKS = b".,;:!?*%$&#|)"
#: Bytes of records that ``read_records`` holds at once in a task, about.
READ_BYTES = 1 << 22
#: Shards whose first ids a broadcast may hold; beyond, they are joined by a shuffle.
BROADCAST_SHARDS = 100_000
INDEX_SCHEMA = "doc_id bigint, shard string, offset bigint, length bigint, n_tokens bigint, part int, place bigint"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_record(f: BinaryIO) -> bytes | None:
    """The next payload, None at the end of the file; a damaged record raises ValueError."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("the length of a record is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError("the payload of a record is damaged")
    return body[:n]


class Encoder:
    """Ids of whole texts, as bytes; each distinct white-space-free piece is encoded once.

    The vocabulary's rules never look across ASCII white space, so a text's ids are the ids of
    its pieces one after another. Of a new piece that is a Latin word with marks behind it,
    word and marks are two units of the rules, which the library's model encodes without its
    costly splitting; any other new piece goes through the whole library.
    """

    def __init__(self, path: str, width: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.known = Known(self)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: how the library writes the bytes of a letter
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in LATIN}
        self.simple = True
        self.simple = self._agrees()
        self.known.clear()

    def _agrees(self) -> bool:
        """Whether the model alone gives what the whole library gives for words with marks."""
        probe = "Aber Ééß\u00ff\u0141ou ththbleon the, of. and*** x%%% \u00dcber) ing;"
        return b"".join(x for p in probe.encode().split() for x in self.parts(p) or (b"",)) == np.array(self.ids(probe), dtype=self.dtype).tobytes()

    def _model(self, unit: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(unit)], dtype=self.dtype).tobytes()

    def parts(self, piece: bytes) -> tuple[bytes, ...] | None:
        """Ids of a word and of the marks behind it; None if the piece is something else."""
        base = piece.rstrip(MARKS)
        marks = piece[len(base) :]
        if base and marks:
            # the word's own entry, if it is one the rules keep whole
            return (self.known[base], self.known[marks]) if LATIN_WORD.fullmatch(base.decode()) else None
        if base and LATIN_WORD.fullmatch(text := base.decode()):
            return (self._model(text.lower().translate(self.letters)),)
        return (self._model(marks.decode()),) if marks else None

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, values: list[bytes]) -> Iterator[bytes]:
        for text in values:
            if len(self.known) > MEMORY:
                self.known.clear()
            yield b"".join(map(self.known.__getitem__, text.split()))


class Known(dict):
    """Ids by piece; a piece that is not there is encoded when it is asked for."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: bytes) -> bytes:
        parts = self.encoder.parts(piece) if self.encoder.simple else None
        found = np.array(self.encoder.ids(piece.decode()), dtype=self.encoder.dtype).tobytes() if parts is None else b"".join(parts)
        self[piece] = found
        return found


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    """Writes the shards and the index below ``folder``; returns the index.

    doc_id, shard, offset, length, n_tokens, start, width: one row for each row of ``docs``. A
    null text is an empty one, and its record holds the end id alone; a long text is one
    record, encoded whole; a null doc_id comes first; rows of one doc_id lie in the order of a
    hash of their text, and equal rows are repeated. An empty table makes an empty index and no
    shard. No column but doc_id and text is looked at.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1) <= 1 << 16 else 4
    end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
    # the range's number goes with the rows: partitions of later reads need not keep it
    rows = clash_free(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, base = _place(folder)
        name = f"shard-{part:06d}.rec"
        draft, f, offset, place = str(PurePosixPath(base, f".{name}.{uuid.uuid4().hex}")), None, 0, 0
        encoder = _encoder(vocabulary, width)
        try:
            for b in cuts(batches):
                if f is None:
                    fs.create_dir(base, recursive=True)
                    f = fs.open_output_stream(draft)
                offsets, lengths = [], []
                for payload in encoder.encode(texts(b.column(1))):
                    record = frame(payload + end)
                    f.write(record)
                    offsets.append(offset)
                    lengths.append(len(record))
                    offset += len(record)
                n = len(offsets)
                counts = (np.array(lengths, dtype=np.int64) - 16) // width
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([name] * n), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(counts), pa.array([part] * n, pa.int32()), pa.array(np.arange(place, place + n))],
                    names=["doc_id", "shard", "offset", "length", "n_tokens", "part", "place"],
                )
                place += n
        finally:
            if f is not None:
                f.close()
        if f is not None:
            fs.move(draft, str(PurePosixPath(base, name)))

    drafted, drafted_at = stored_at(rows.mapInArrow(write, INDEX_SCHEMA), "index")
    # ids in all shards before each: a row a shard, so at most the shuffle's partitions
    totals = drafted.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    if bases.count() <= BROADCAST_SHARDS:
        bases = F.broadcast(bases)
    # within a shard the running sum follows from the offsets: a record has 16 bytes besides its ids
    start = F.col("base") + ((F.col("offset") - 16 * F.col("place")) / width).cast("bigint")
    index = drafted.join(bases, "part").select("doc_id", "shard", "offset", "length", "n_tokens", start.alias("start"), F.lit(width).alias("width"))
    index.write.parquet(f"{folder}/index")
    discard(spark, drafted_at)
    fs, base = _place(folder)
    for info in fs.get_file_info(pafs.FileSelector(base)):
        if info.base_name.startswith(".shard-"):
            fs.delete_file(info.path)
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of records that ``write_records`` wrote below ``folder``, for ``read_records``."""
    return spark.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, most: int = READ_BYTES) -> DataFrame:
    """The documents of ``index`` read back from the shards, each by its offset.

    doc_id, start, n_tokens, ids (array of ints). Rows may come in any order and any choice. A
    task holds records of about ``most`` bytes at once; a longer one is held alone.
    """
    kernel = _reader(folder, "ids", lambda ids: ids.astype(np.int32), lambda out: pa.ListArray.from_arrays(pa.array(starts_of([len(x) for x in out]).astype(np.int32)), pa.array(np.concatenate(out))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cuts(batches):
            lengths = b.column("length").to_numpy(zero_copy_only=False)
            group = (np.cumsum(lengths) - lengths) // most
            for rows in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(group)) + 1):
                if len(rows):
                    yield kernel(b.slice(rows[0], len(rows)))

    return index.select("doc_id", "shard", "offset", "length", "start", "width").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def _reader(folder: str, name_of: str, digest, gather):
    """A kernel that reads the records of a batch of the index in file order; ``digest`` of each goes into the column of that name."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        fs, base = _place(folder)
        order = sorted(range(b.num_rows), key=lambda i: (shards[i], offsets[i])) if (shards := b.column("shard").to_pylist(), offsets := b.column("offset").to_pylist()) else []
        widths, counts, out = b.column("width").to_pylist(), [0] * b.num_rows, [None] * b.num_rows
        f, name = None, None
        for i in order:
            if shards[i] != name:
                if f is not None:
                    f.close()
                name = shards[i]
                f = fs.open_input_file(str(PurePosixPath(base, name)))
            f.seek(offsets[i])
            ids = np.frombuffer(read_record(f), dtype=f"<u{widths[i]}")
            counts[i], out[i] = len(ids), digest(ids)
        if f is not None:
            f.close()
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(counts, pa.int64()), gather(out)], names=["doc_id", "start", "n_tokens", name_of])

    return kernel


def digests(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the shards."""
    kernel = _reader(folder, "ids_crc32", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), lambda out: pa.array(out, pa.int64()))
    return per_batch(index.select("doc_id", "shard", "offset", "start", "width"), kernel, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def written(docs: DataFrame, spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """Writes ``docs`` to a fresh folder in the shared one and reports what the files hold."""
    folder = scratch(spark, "records")
    return digests(write_records(docs, folder, vocabulary or vocabulary_path()), folder)
