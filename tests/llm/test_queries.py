"""The registered queries and the pipeline over tables of hard rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm.common import words_of
from tessella.llm.decontamination import item_windows
from tessella.llm.media import pad_payload
from tessella.llm.queries import queries
from tessella.llm.simhash import fingerprint
from test_fingerprints import brute as fingerprints_brute
from test_licenses import base_brute

ITEMS = [(1, "same text here for ties and nothing else"), (2, None), (3, " ,"), (4, "the MIT license"), (None, "x"), (5, "word " * 12), (6, "word " * 40)]
MORE = [
    (20, "Released under the MIT License. CC BY and the Apache License, Version 2.0", "en", "src1"),
    (21, "GNU General Public License <|endoftext|> idiot", None, "web.org/a"),
    (22, "one two three four five six seven eight nine ten", "en", None),
    (23, "one two three four five six seven eight nine ten", "fr", "web.org/b"),
]


@pytest.fixture(scope="module", params=["hard", "clashing", "empty"])
def tables(request, spark, hard, clashing, empty, tmp_path_factory):
    """A folder of tables, and the documents in it."""
    folder = str(tmp_path_factory.mktemp(request.param))
    docs = {"hard": hard, "clashing": clashing, "empty": empty}[request.param]
    docs = docs.selectExpr("*", "if(doc_id < 3, null, 'en') as lang", "if(doc_id < 5, 'src1', 'web.org/a') as source", "int(length(text)) as n_chars")
    if request.param == "hard":
        more = spark.createDataFrame(MORE, "doc_id bigint, text string, lang string, source string")
        docs = docs.unionByName(more.selectExpr("*", "int(length(text)) as n_chars"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int(i == 21)) for i in (1, 4, 6, 7, 20, 21, 22)] + [(6, None, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def run(spark, tables, name):
    return queries()[name](spark, tables[0]).collect()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, tables):
    want = Counter()
    for i, t in tables[1]:
        n, base = base_brute(t)
        places = [p for p, _ in base]
        want[i, n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({b for _, b in base}))] += 1
    rows = run(spark, tables, "op1_license_scan")
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    for r in rows:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert all(r.score == 1 and "mit-notice" in r.labels.split(",") for r in rows if r.doc_id == 20)


@pytest.mark.parametrize("name, columns", [("op2_quality", ["evidence", "posterior"]), ("op3_word_cross_entropy", ["score"]), ("op10_toxicity", ["p_kind_1", "p_kind_2", "p_toxic"])])
def test_every_document_has_finite_scores(spark, tables, name, columns):
    rows = run(spark, tables, name)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in tables[1])
    assert all(np.isfinite([r[c] for c in columns]).all() for r in rows)


def test_op4(spark, tables):
    windows = {}
    for item, text in ITEMS:
        for w in item_windows((text or "").encode(), 10) if item is not None else ():
            windows.setdefault(w, set()).add(str(item))
    want = Counter()
    for i, t in tables[1]:
        words, hit, items = words_of(t.encode()), set(), set()
        for m in {w.count(b" ") + 1 for w in windows}:
            for at in range(len(words) - m + 1):
                found = windows.get(b" ".join(words[at : at + m]))
                if found:
                    hit |= set(range(at, at + m))
                    items |= found
        want[i, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)] += 1
    rows = run(spark, tables, "op4_decontamination")
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want


def test_op6(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(run(spark, tables, "op6_token_files"), key=lambda r: r.start)
    encoded = [(i, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t in tables[1]]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in encoded)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]


def test_op7(spark, tables):
    want = Counter()
    for i, t in tables[1]:
        payload = pad_payload(t.encode())
        want[i, len(t.encode()), len(payload), sha(payload), zlib.crc32(payload[-32:])] += 1
    rows = run(spark, tables, "op7_media")
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.payload_sha256, r.media_bytes, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})


def test_op8(spark, tables):
    fps = [(i, fingerprint(t.encode())) for i, t in tables[1]]
    near = lambda a, b: bin(a ^ b).count("1") <= 4
    want = Counter()
    for i, f in fps:
        group, size = {f}, 0
        while size < len(group):
            size = len(group)
            group |= {g for _, g in fps if any(near(g, h) for h in group)}
        want[i, f"{f:016x}", min((j for j, g in fps if g in group and j is not None), default=None)] += 1
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, tables, "op8_simhash")) == want


def test_op9(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in tables[1]:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, tables, "op9_bpe")) == want


def test_op11(spark, tables):
    rows = run(spark, tables, "op11_fingerprints")
    assert Counter(map(tuple, rows)) == fingerprints_brute(tables[1])


def test_pipeline(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    ids = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in tables[1])
    got = Counter((r.doc_id, tuple(r.ids)) for r in rows)
    assert all(n <= ids[key] for key, n in got.items())
    texts = {tuple(library.encode(t, add_special_tokens=False).ids) for i, t in tables[1]}
    assert len({k[1] for k in got}) == len(rows) <= len(texts)  # one of each group stays


def test_without_labels_the_classifiers_drop_nothing(spark, hard):
    docs = hard.selectExpr("*", "'en' as lang", "if(doc_id < 5, 'src1', 'web.org/a') as source")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    from tessella.llm import quality, toxicity

    assert quality.keep_good(docs, labels).count() == toxicity.drop_toxic(docs, labels).count() == docs.count()
