import math
from collections import Counter

import numpy as np

from tessella.llm.language_model import CLASSES, PRIOR, byte_class, cross_entropy_difference, flag_target, gram_codes


def plain_losses(texts, corpus):
    """Interpolated four-gram losses with dictionaries, order by order."""
    grams = [Counter() for _ in range(5)]
    for t in corpus:
        s = [27] * 3 + [byte_class(b) for b in t.encode()]
        for i in range(3, len(s)):
            for k in range(1, 5):
                grams[k][tuple(s[i - k + 1 : i + 1])] += 1
    contexts = [Counter() for _ in range(5)]
    for k in range(1, 5):
        for g, n in grams[k].items():
            contexts[k][g[:-1]] += n

    def p(g):
        if len(g) == 1:
            return (grams[1][g] + 1) / (contexts[1][()] + CLASSES)
        return (grams[len(g)][g] + PRIOR * p(g[1:])) / (contexts[len(g)][g[:-1]] + PRIOR)

    out = []
    for t in texts:
        s = [27] * 3 + [byte_class(b) for b in t.encode()]
        out.append(sum(-math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / max(1, len(s) - 3))
    return out


def test_losses_equal_plain_dictionaries(spark):
    rows = [(1, "The cat sat.", True), (2, "Die Katze saß!", False), (3, None, True), (4, "", None), (5, "aa 11 %% é", None), (5, "The cat sat.", True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    got = {(r.doc_id, r.n_tokens): r for r in cross_entropy_difference(frame, frame, "target").collect()}
    texts = [t or "" for _, t, _ in rows]
    background = plain_losses(texts, texts)
    target = plain_losses(texts, [t or "" for _, t, f in rows if f])
    for (i, _, _), t, b, g in zip(rows, texts, background, target):
        r = got[i, len(t.encode())]
        assert np.allclose((r.background_loss, r.target_loss, r.score), (b, g, g - b))


def test_target_texts_score_lower(spark):
    rows = [(i, "vowels aeiou aaa eee", True) for i in range(30)] + [(100 + i, "zzz xxx qqq kkk", False) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    scores = {r.doc_id: r.score for r in cross_entropy_difference(frame, frame, "target").collect()}
    assert max(s for i, s in scores.items() if i < 100) < 0 < min(s for i, s in scores.items() if i >= 100)


def test_hard_rows(spark, hard, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (6, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    for frame in (hard, clashing, empty):
        flagged = flag_target(frame, labels)
        assert flagged.count() == frame.count() and flagged.where("target").count() == (3 if frame is not empty else 0)
        assert cross_entropy_difference(frame, flagged, "target").count() == frame.count()
    assert gram_codes(b"").tolist() == []
