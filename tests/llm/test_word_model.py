import math
from collections import Counter

import numpy as np

from tessella.llm.common import words_of
from tessella.llm.language_model import PRIOR
from tessella.llm.queries import queries
from tessella.llm.word_model import packed, unpacked, word_cross_entropy


def plain_losses(texts, corpus):
    """The two models with dictionaries: (tokens, target loss, background loss) of each text."""
    read = lambda t: [*words_of((t or "").encode()), "end"] if words_of((t or "").encode()) else []
    counted = []
    for of in ([t for t, f in corpus if f], [t for t, _ in corpus]):
        c = Counter()
        for s in map(read, of):
            for v, w in zip(["start", *s], s):
                c.update([(w,), (v, w), ("context", v, None), ()])
        counted.append(c)
    share = lambda w: counted[1][w,] / counted[1][()]
    out = []
    for s in map(read, texts):
        sums = []
        for c in counted:
            p = lambda v, w: (c[v, w] + PRIOR * (c[w,] + PRIOR * share(w)) / (c[()] + PRIOR)) / (c["context", v, None] + PRIOR)
            sums.append(sum(-math.log(p(v, w)) for v, w in zip(["start", *s], s)) / max(1, len(s)))
        out.append((len(s), *sums))
    return out


ROWS = [(1, "The cat sat. The cat"), (2, "кот спит, кот"), (3, None), (4, " ,. "), (5, "пёс идёт"), (5, "the cat"), (None, "the end"), (6, "猫 は")]
GOOD = [(1, 1), (1, 0), (5, 1), (2, 0), (None, 1), (99, 1)]


def test_losses_equal_plain_dictionaries(spark):
    docs, labels = spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame(GOOD, "doc_id long, quality int")
    want = plain_losses([t for _, t in ROWS], [(t, i in (1, 5)) for i, t in ROWS])
    want = sorted((str(i), n, round(t, 9), round(b, 9)) for (i, _), (n, t, b) in zip(ROWS, want))
    for chunk_bytes in (1 << 20, 20):
        got = word_cross_entropy(docs, labels, chunk_bytes=chunk_bytes).collect()
        assert sorted((str(r.doc_id), r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9)) for r in got) == want
        assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-9 for r in got)


def test_packed_counts_come_back():
    counts = np.array([0, 1, 254, 255, 256, 3, 2**40], np.int64)
    for some in (counts, counts[:0], counts[:3], counts[3:5]):
        assert unpacked(packed(some)).tolist() == some.tolist()


def test_words_of_other_scripts_differ(spark):
    # the same byte lengths, spaces and marks: one text to the byte classes of language_model
    rows = [(i, "кот и пёс" if i % 2 else "дом у рек") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in word_cross_entropy(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS quality")).collect()}
    assert max(s for i, s in scores.items() if i % 2) < 0 < min(s for i, s in scores.items() if i % 2 == 0)


def test_hard_rows(spark, hard, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (6, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    for frame in (hard, clashing, empty):
        for some in (labels, labels.limit(0)):
            got = word_cross_entropy(frame, some).collect()
            assert len(got) == frame.count() and np.isfinite([r.score for r in got]).all()


def test_query_has_every_document(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op3_word_cross_entropy"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
