"""Token ids in Arrow files of fixed-size lists, packed to equal-length sequences.

A data set is a folder with two files for each part:

``part-NNNNN.sequences.arrow``  batches of (ids fixed_size_list<uint16|uint32>[L],
    mask fixed_size_list<uint8>[L / 8, rounded up]); documents follow each other
    without gaps, and the last sequence is padded where its mask's bits are 0. The
    mask of a sequence has bytes of its own, eight places in each from the lowest
    bit up, so that it is a view of the file like the ids;
``part-NNNNN.documents.arrow``  (doc_id, first, n): where each document's ids lie
    in the part.

Parts are in ascending order of documents. The files are uncompressed Arrow IPC
with a footer, so any sequence and its mask are reached, without copying, by their
number alone: batch number // BATCH, row number % BATCH.
"""

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tessella.llm.tokenizers import Memo, Vocabulary, byte_letters
from tessella.sources.shared import materialise, new_path

SEQUENCE = 2048
BATCH = 64
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordEncoder:
    """The tokenizers library's ids for whole texts, word by word through a cache.

    Only for vocabularies whose normaliser lower-cases and whose split drops all
    white space, so that a text's ids are those of its words in turn. A text
    that may hold a special token goes to the library whole.
    """

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.merges = self.library.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.words = Memo(self._word, 250_000, longest=32)

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if text[-1] in ".," and text[:-1].isalpha() and text.islower():
            return self.words[word[:-1]] + self.words[word[-1:]]
        if text.isalpha() and text.islower() and unicodedata.is_normalized("NFC", text):
            # Nothing to normalise or split: only the library's merges are left.
            letters = word.decode("latin-1").translate(self.letters)
            return np.array([t.id for t in self.merges(letters)], self.kind).tobytes()
        return self._ids(text)

    def encode(self, text: bytes) -> bytes:
        if any(s in text for s in self.special):
            return self._ids(text.decode())
        return b"".join([self.words[w] for w in text.translate(LOWER).split()])


def _filesystem(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _sequence_schema(kind: np.dtype, length: int) -> pa.Schema:
    ids = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.uint8(), -(-length // 8)))])


class _PartWriter:
    """Writes one part under temporary names; ``close`` renames, so a retried task is harmless."""

    def __init__(self, folder: str, part: int, attempt: int, kind: np.dtype, length: int, id_type: pa.DataType):
        self.fs, base = _filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.names = [f"{base}/part-{part:05d}.{what}.arrow" for what in ("sequences", "documents")]
        self.temporary = [f"{n}.{attempt}.tmp" for n in self.names]
        self.kind, self.length, self.schema = kind, length, _sequence_schema(kind, length)
        self.index_schema = pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n", pa.int64())])
        self.files = [self.fs.open_output_stream(t) for t in self.temporary]
        self.sequences = pa.ipc.new_file(self.files[0], self.schema)
        self.documents = pa.ipc.new_file(self.files[1], self.index_schema)
        self.waiting, self.n_waiting, self.total = [], 0, 0

    def add(self, doc_ids: pa.Array, encoded: list[bytes]) -> None:
        sizes = np.array([len(e) // self.kind.itemsize for e in encoded], np.int64)
        firsts = self.total + np.cumsum(sizes) - sizes
        self.documents.write_batch(pa.record_batch([doc_ids, pa.array(firsts), pa.array(sizes)], schema=self.index_schema))
        self.total += int(sizes.sum())
        self.waiting += encoded
        self.n_waiting += int(sizes.sum())
        if self.n_waiting >= self.length * BATCH:
            self._flush(self.length * BATCH)

    def _flush(self, multiple: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.kind)
        whole = len(ids) // multiple * multiple
        for at in range(0, whole, self.length * BATCH):
            self._write(ids[at : min(at + self.length * BATCH, whole)], None)
        self.waiting, self.n_waiting = [ids[whole:].tobytes()], len(ids) - whole

    def _write(self, ids: np.ndarray, used: int | None) -> None:
        mask = np.ones(len(ids), np.uint8)
        if used is not None:
            mask[used:] = 0
        mask = np.packbits(mask.reshape(-1, self.length), axis=1, bitorder="little").ravel()
        kinds = self.schema.types
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(v, k.value_type), k.list_size) for v, k in zip((ids, mask), kinds)
        ]
        self.sequences.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(self.length * BATCH)
        if self.n_waiting:
            rest = np.frombuffer(b"".join(self.waiting), self.kind)
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        for writer, file, temporary, name in zip((self.sequences, self.documents), self.files, self.temporary, self.names):
            writer.close()
            file.close()
            self.fs.move(temporary, name)


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    folder: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the files; returns the parts.

    Documents go in ascending order of id: nulls first, equal ids in order of
    arrival. A null text gives just the end id. Rows are dealt by range of
    (id, arrival), so that many rows with one id spread over tasks. Returns the
    written table of parts (part, n_documents, n_tokens, first), where first
    counts the ids in all parts before. An empty table writes nothing.
    """
    shared = Vocabulary(docs.sparkSession, vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.build(WordEncoder)
        end = np.array([end_id], encoder.kind).tobytes()
        context, writer, n = TaskContext.get(), None, 0
        for batch in batches:
            if writer is None:
                writer = _PartWriter(
                    folder, context.partitionId(), context.taskAttemptId(), encoder.kind, length, batch.schema.types[0]
                )
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = some.column(1).cast(pa.binary()).to_pylist()
                writer.add(some.column(0), [encoder.encode(t or b"") + end for t in texts])
            n += batch.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "n_documents": [n], "n_tokens": [writer.total]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("arrival", F.monotonically_increasing_id()).repartitionByRange("doc_id", "arrival")
    parts = rows.sortWithinPartitions("doc_id", "arrival").select("doc_id", "text")
    parts = materialise(parts.mapInArrow(write, "part bigint, n_documents bigint, n_tokens bigint"), "parts")
    return parts.withColumn("first", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


def open_part(folder: str, part: int, what: str) -> pa.ipc.RecordBatchFileReader:
    """Reader of one file; files on a local or mounted path are memory-mapped."""
    fs, base = _filesystem(folder)
    name = f"{base}/part-{part:05d}.{what}.arrow"
    source = pa.memory_map(name) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(name)
    return pa.ipc.open_file(source)


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask bits of sequence ``number`` of a part; both are views of the file."""
    batch = reader.get_batch(number // BATCH)
    row = number % BATCH
    ids, mask = (column.values.slice(row * column.type.list_size, column.type.list_size).to_numpy(zero_copy_only=True) for column in batch.columns)
    return ids, mask


def in_use(mask: np.ndarray, length: int) -> np.ndarray:
    """The truth values of a mask's bits, unpacked."""
    return np.unpackbits(mask, count=length, bitorder="little").view(np.bool_)


def _document_checksums(folder: str, part: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, first, n, crc32 of the ids as little-endian uint32) of one part, read in order."""
    sequences, documents = open_part(folder, part, "sequences"), open_part(folder, part, "documents")
    number, start, ids = -1, 0, np.empty(0, np.uint32)

    for i in range(documents.num_record_batches):
        index = documents.get_batch(i)
        sums = []
        for first, n in zip(index.column(1).to_pylist(), index.column(2).to_pylist()):
            crc = 0
            while n:
                while first >= start + len(ids):
                    start += len(ids)
                    number += 1
                    ids = sequences.get_batch(number).column(0).values.to_numpy(zero_copy_only=True).astype("<u4")
                piece = ids[first - start : first - start + n]
                crc = zlib.crc32(piece.tobytes(), crc)
                first, n = first + len(piece), n - len(piece)
            sums.append(crc)
        yield pa.record_batch([*index.columns, pa.array(sums, pa.int64())], names=["doc_id", "first", "n", "crc"])


def read_documents(spark: SparkSession, folder: str, parts: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row a document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``parts`` is what ``write_token_files`` returned; parts are dealt by range, one to a task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for got in _document_checksums(folder, part):
                    start = pa.array(np.asarray(got.column(1)) + first)
                    yield pa.record_batch(
                        [got.column(0), start, got.column(2), got.column(3)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, parts.count())
    todo = parts.select("part", "first").repartitionByRange(n, "part")
    return todo.mapInArrow(read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files, where all executors can reach it."""
    return new_path(spark, "tokens")
