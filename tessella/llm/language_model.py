"""Cross-entropy difference of two matched n-gram models.

Tokens are the bytes of a text, read as 32 classes: the letters, digits, white
space, full stops, other marks, and the bytes of other scripts. Target and
background models share this vocabulary, the order and the smoothing; both are
counted over all documents, the target's over those flagged. Counts of a model
have at most 32 ** ORDER rows (2 ** 20), whatever the corpus, so the loss table
is broadcast. Each token's loss under either model is added up; a document's
score is the difference per token, target minus background: the lower, the more
like the target.

Order k smooths with order k - 1 as prior worth ``PRIOR`` tokens; the unigrams
with one token of each class. Before a text stand ORDER - 1 blanks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bytes_udf, struct_array, utf8_values

ORDER = 4
CLASSES = 32
PRIOR = 32.0
DIGIT, BLANK, STOP, MARK, LEAD, NEXT = 26, 27, 28, 29, 30, 31


def byte_class(b: int) -> int:
    """The class of one byte; 0 to 25 are the letters."""
    if chr(b).isascii() and chr(b).isalpha():
        return (b | 0x20) - 0x61
    if 0x30 <= b <= 0x39:
        return DIGIT
    if b in b" \t\n\r":
        return BLANK
    if b in b".!?":
        return STOP
    return MARK if b < 0x80 else NEXT if b < 0xC0 else LEAD


CLASS_OF = bytes(map(byte_class, range(256)))
_START = bytes([BLANK]) * (ORDER - 1)


def gram_codes(text: bytes) -> np.ndarray:
    """For each token the number of its n-gram: ORDER classes as digits to base 32."""
    s = np.frombuffer(_START + text.translate(CLASS_OF), np.uint8).astype(np.int32)
    n = len(s) - ORDER + 1
    codes = np.zeros(n, np.int32)
    for k in range(ORDER):
        codes = codes * CLASSES + s[k : k + n]
    return codes


def count_grams(docs: DataFrame, flag_col: str, text_col: str = "text") -> DataFrame:
    """(gram, background, target): how often each n-gram occurs in all and in flagged documents.

    Each task adds up its own counts, so the shuffle has a row a task and gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, CLASSES**ORDER), np.int64)
        for batch in batches:
            for flagged, at in ((False, 0), (True, 1)):
                texts = [t for t, f in zip(utf8_values(batch.column(0)), batch.column(1).to_pylist()) if bool(f) == flagged]
                for i in range(0, len(texts), 200):
                    codes = np.concatenate([gram_codes(t) for t in texts[i : i + 200]])
                    totals[at] += np.bincount(codes, minlength=CLASSES**ORDER)
        seen = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_pydict({"gram": seen, "background": totals.sum(axis=0)[seen], "target": totals[1][seen]})

    rows = docs.select(F.col(text_col), F.coalesce(F.col(flag_col), F.lit(False)))
    counted = rows.mapInArrow(count, "gram bigint, background bigint, target bigint")
    return counted.groupBy("gram").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def losses(counts: np.ndarray) -> np.ndarray:
    """Loss, in nats, of the last token of every n-gram, from the n-gram counts."""
    counts = counts.astype(np.float64).reshape((CLASSES,) * ORDER)
    unigrams = counts.sum(axis=tuple(range(ORDER - 1)))
    p = (unigrams + 1) / (unigrams.sum() + CLASSES)
    for k in range(2, ORDER + 1):
        grams = counts.sum(axis=tuple(range(ORDER - k)))
        p = (grams + PRIOR * p) / (grams.sum(axis=-1, keepdims=True) + PRIOR)
    return -np.log(p).ravel()


def add_losses(docs: DataFrame, tables: tuple[np.ndarray, np.ndarray], text_col: str = "text", out_col: str = "losses") -> DataFrame:
    """``docs`` with a struct: n_tokens and the summed loss under target and background."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def batch(texts: list[bytes]) -> pa.Array:
        target, background = shared.value
        found = []
        for t in texts:
            codes = gram_codes(t)
            found.append((len(codes), float(target[codes].sum()), float(background[codes].sum())))
        return struct_array(
            [
                ("n_tokens", pa.int64(), [f[0] for f in found]),
                ("target", pa.float64(), [f[1] for f in found]),
                ("background", pa.float64(), [f[2] for f in found]),
            ]
        )

    kind = "struct<n_tokens:bigint,target:double,background:double>"
    return docs.withColumn(out_col, bytes_udf(batch, kind)(F.col(text_col)))


def cross_entropy_difference(docs: DataFrame, flagged: DataFrame, flag_col: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (per token) of ``docs``.

    ``flagged`` has the corpus: a column text and a boolean ``flag_col`` for the
    target. Null flags count as false, null texts as empty; a text without
    tokens has losses and score 0.
    """
    counts = count_grams(flagged, flag_col).toArrow()  # at most CLASSES ** ORDER rows
    dense = np.zeros((2, CLASSES**ORDER))
    dense[:, counts["gram"].to_numpy()] = [counts["target"].to_numpy(), counts["background"].to_numpy()]
    scored = add_losses(docs, (losses(dense[0]), losses(dense[1])))
    n = F.greatest(F.col("losses.n_tokens"), F.lit(1))
    target, background = F.col("losses.target") / n, F.col("losses.background") / n
    return scored.select(
        "doc_id",
        "losses.n_tokens",
        target.alias("target_loss"),
        background.alias("background_loss"),
        (target - background).alias("score"),
    )


def flag_target(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """text and target: whether a label of 1 marks the document.

    An id with several labels is flagged if any is 1; null ids never are. Labels
    grow with the corpus, so they are merged in at every size, never broadcast.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("good_id")).distinct().hint("merge")
    joined = docs.select(F.col(id_col).alias("id"), "text").join(good, F.col("id") == F.col("good_id"), "left")
    return joined.select("text", F.col("good_id").isNotNull().alias("target"))
