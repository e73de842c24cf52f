import random

from tessella.llm import decontamination
from tessella.llm.common import words_of
from tessella.llm.decontamination import (
    WuManber,
    drop_contaminated,
    find_contamination,
    item_windows,
    n_hit,
)


def brute(text, items, size=10):
    words, hit, found = words_of((text or "").encode()), set(), set()
    for item, of in items:
        if item is None:
            continue
        for w in item_windows((of or "").encode(), size):
            w = w.split(b" ")
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab c! é D".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(8)]
    items += [(8, None), (None, "a b"), (9, items[0][1])]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(100 + i, f"{docs[i][1]} {t} tail") for i, (_, t) in enumerate(items) if t]
    return docs, items


def test_search_equals_direct_comparison():
    for seed in range(6):
        docs, items = cases(seed)
        patterns = {}
        for item, text in items:
            for w in item_windows((text or "").encode(), 10):
                if item is not None:
                    patterns[w] = patterns.get(w, ()) + (str(item),)
        search = WuManber(patterns)
        for _, text in docs:
            n, spans, found = search.scan(text.encode())
            assert (n, sum(b - a for a, b in spans), sorted(found)) == brute(text, items)


def test_blocks_give_the_same(spark, hard):
    docs, items = cases(11)
    frame = spark.createDataFrame(docs, "doc_id long, text string").union(hard)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (200_000, 9):
        got = find_contamination(frame, bench, block_patterns=block)
        rows = got.select("text", "contamination.n_words", n_hit(got.contamination).alias("n"), "contamination.items").collect()
        assert len(rows) == frame.count()
        assert all((r.n_words, r.n, r["items"]) == brute(r.text, items) for r in rows)


def test_a_reused_address_does_not_bring_back_another_benchmark(spark, monkeypatch):
    # every object at one address, as when the first call's table has been freed, and both searches in one process
    monkeypatch.setattr(decontamination, "id", lambda _: 1, raising=False)
    searches, make = [], decontamination.bytes_udf
    monkeypatch.setattr(decontamination, "bytes_udf", lambda batch, kind: (searches.append((kind, batch)), make(batch, kind))[1])
    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")
    for text in ("alpha beta", "two three"):
        find_contamination(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    first, second = (batch for kind, batch in searches if kind == decontamination.RESULT)
    for search, want in ((first, [["1"], []]), (second, [[], ["1"]])):
        assert search([b"alpha beta", b"one two three"]).field("items").to_pylist() == want


def test_empty_tables_and_clashes(spark, empty, clashing):
    bench = spark.createDataFrame([(1, "same text here for ties and nothing else")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(empty, bench).count() == 0
    assert find_contamination(clashing, none).where("size(contamination.items) > 0").count() == 0
    kept = drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns
    assert kept.count() == clashing.count() - 3
