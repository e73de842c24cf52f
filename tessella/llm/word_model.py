"""Cross-entropy difference of two word-pair models over the whole corpus.

Tokens are the words of a text and an end after the last one; a text without
words has none. The vocabulary is every word of the corpus, in any script, and
the models have every pair of successive tokens, so they grow with the corpus.
Target and background share vocabulary, order and smoothing, as in
``language_model``: a pair smooths with the token's probability as prior worth
``PRIOR`` tokens, and that with the token's share of the whole corpus.

Nothing is collected or broadcast. Texts are dealt to chunks by a hash of the
id. A chunk sends each distinct token and pair it holds once, with its counts,
to the bucket of that key; a bucket adds the counts of all chunks and sends the
totals back in the same order. However common a key, a bucket has it once a
chunk, and a chunk sends nothing to a bucket it has no keys for, so there are
never more messages than distinct keys in the chunks. Keys are 64-bit hashes.
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import utf8_values, words_of
from tessella.llm.language_model import PRIOR

#: UTF-8 bytes of text in a chunk, about; there are as many buckets as chunks.
CHUNK_BYTES = 16 << 20
COUNT = np.dtype("<i8")
KEY = np.dtype("<u8")


def word_key(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


# No word holds white space, so these are none.
START, END, TOTAL = (np.uint64(word_key(w)) for w in (b" start", b" end", b" total"))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A key for each ordered pair of keys."""
    z = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0xD1B54A32D192ED03))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all tokens, text by text, and each text's number of tokens."""
    number: dict[bytes, int] = {b" end": 0}
    parts, sizes = [], []
    for text in texts:
        words = words_of(text)
        if words:
            words.append(b" end")
            parts.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
        sizes.append(len(words))
    keys = np.fromiter(map(word_key, number), KEY, len(number))
    return keys[np.concatenate(parts)] if parts else np.empty(0, KEY), np.array(sizes, np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts as single bytes, and those from 255 on in full after them."""
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(COUNT).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    counts = np.frombuffer(data, np.uint8, n, 8).astype(COUNT)
    counts[counts == 255] = np.frombuffer(data, COUNT, offset=8 + n)
    return counts


class Chunk:
    """The texts of a chunk as keys; made twice, to send counts and to use totals."""

    def __init__(self, docs: pa.Table, buckets: int):
        self.ids = docs["doc_id"]
        tokens, self.sizes = token_keys(utf8_values(docs["text"].combine_chunks()))
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        ends = np.cumsum(self.sizes)
        before[(ends - self.sizes)[self.sizes > 0]] = START
        every = np.concatenate([tokens, pair_keys(before, tokens), np.array([TOTAL])])
        keys, self.at = np.unique(every, return_inverse=True)
        # after a start comes one token a text, as many as there are ends
        context = np.where(before == START, END, before)
        self.context = np.searchsorted(keys, context)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.buckets, self.starts = np.unique(bucket[self.order], return_index=True)
        self.keys, self.n = keys, len(tokens)

    def counts(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs, in all and in flagged texts."""
        flagged = np.repeat(flags, self.sizes)
        weights = np.concatenate([flagged, flagged, [flagged.sum()]]).astype(float)
        every = np.bincount(self.at, minlength=len(self.keys))
        every[self.at[-1]] = self.n
        return every, np.bincount(self.at, weights, len(self.keys)).astype(np.int64)

    def losses(self, background: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's summed losses under target and background, in nats."""
        token, pair, total = self.at[: self.n], self.at[self.n : -1], self.at[-1]
        share = background[token] / max(1, background[total])
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)

        def of(c: np.ndarray) -> np.ndarray:
            p = (c[token] + PRIOR * share) / (c[total] + PRIOR)
            p = (c[pair] + PRIOR * p) / (c[self.context] + PRIOR)
            return np.bincount(text, -np.log(p), len(self.sizes))

        return of(target), of(background)


def _ids_of(table: pa.Table) -> list:
    return table["doc_id"].to_pylist()


def word_cross_entropy(docs: DataFrame, labels: DataFrame, label_col: str = "quality", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (per token) of ``docs``.

    A document is of the target if a label of its id is 1; null ids never are. A
    text without words has no tokens, and losses and score 0. Rows with one id
    are in one chunk, as their label is; null ids are dealt by their text. An
    empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // chunk_bytes) or 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = lambda key: F.pmod(key, F.lit(n)).cast("int").alias("chunk")
    own = F.xxhash64(F.col("doc_id").cast("string"))
    texts = docs.select(dealt(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(own)), "doc_id", "text")
    good = labels.where((F.col(label_col) == 1) & F.col("doc_id").isNotNull()).select(dealt(own), F.col("doc_id").cast(kind)).distinct()

    def send(docs: pa.Table, good: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary()))})
        chunk, marked = Chunk(docs, n), set(_ids_of(good))
        background, target = chunk.counts(np.array([i in marked for i in _ids_of(docs)]))
        rows = np.split(chunk.order, chunk.starts[1:])
        return pa.table(
            {
                "bucket": pa.array(chunk.buckets, pa.int32()),
                "chunk": pa.array([docs["chunk"][0].as_py()] * len(rows), pa.int32()),
                "keys": pa.array([chunk.keys[r].tobytes() for r in rows], pa.binary()),
                "background": pa.array([packed(background[r]) for r in rows], pa.binary()),
                "target": pa.array([packed(target[r]) for r in rows], pa.binary()),
            }
        )

    def add(sent: pa.Table) -> pa.Table:
        keys, at = np.unique(np.frombuffer(b"".join(sent["keys"].to_pylist()), KEY), return_inverse=True)
        ends = np.cumsum([len(k) // KEY.itemsize for k in sent["keys"].to_pylist()])
        out = {"chunk": sent["chunk"].cast(pa.int32()), "bucket": sent["bucket"].cast(pa.int32())}
        for c in ("background", "target"):
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([unpacked(part) for part in sent[c].to_pylist()]))
            out[c] = pa.array([packed(part) for part in np.split(total[at], ends[:-1])], pa.binary())
        return pa.table(out)

    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        chunk = Chunk(docs, n)
        totals = totals.sort_by("bucket")
        counts = []
        for c in ("background", "target"):
            found = np.zeros(len(chunk.keys), np.int64)
            found[chunk.order] = np.concatenate([unpacked(part) for part in totals[c].to_pylist()])
            counts.append(found)
        target, background = chunk.losses(*counts)
        tokens = np.maximum(chunk.sizes, 1)
        return pa.table(
            {
                "doc_id": chunk.ids,
                "n_tokens": chunk.sizes,
                "target_loss": target / tokens,
                "background_loss": background / tokens,
                "score": (target - background) / tokens,
            }
        )

    sent = texts.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, keys binary, background binary, target binary")
    totals = sent.groupBy("bucket").applyInArrow(add, "chunk int, bucket int, background binary, target binary")
    scored = f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    return texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, scored)
