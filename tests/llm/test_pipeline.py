from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import quality, toxicity
from tessella.llm.common import words_of
from tessella.llm.decontamination import item_windows
from test_near_texts import plain_groups

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's documents, written and read back."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp(name)}/out"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay_and_rows_only_go(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == before.columns
        kept, of = rows(after), rows(before)
        assert after.count() == len(kept) and all(of[i] == r for i, r in kept.items())


def test_quality_and_toxicity_decide(spark, stages):
    labels = rows(spark.read.parquet(f"{SF}/labels.parquet"))
    for before, after, bad in ((stages[0], stages[1], lambda r: r.quality == 0), (stages[1], stages[2], lambda r: r.toxic == 1)):
        kept, of = rows(after), rows(before)
        known = [i for i in of if i in labels]
        assert all(i in kept for i in known if not bad(labels[i]))
        assert sum(i in kept for i in known if bad(labels[i])) <= 0.1 * max(1, sum(bad(labels[i]) for i in known))


def test_one_of_each_group_stays(stages):
    """Groups by all pairs: SimHash within four bits, or shingle sets at 0.8. At least nine in ten near copies go, and no document without one."""
    of, kept = rows(stages[2]), rows(stages[3])
    group = plain_groups({r.text for r in of.values()})
    members = {}
    for i, r in of.items():
        members.setdefault(group[r.text], []).append(i)
    assert all(min(m) in kept for m in members.values())
    copies = [i for m in members.values() for i in m if i != min(m)]
    assert len(copies) > 20 and sum(i in kept for i in copies) <= 0.1 * len(copies)
    assert {i for i in of if i not in kept} <= set(copies)


def test_contaminated_documents_go(spark, stages):
    windows = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in item_windows(r.text.encode(), 10)}
    sizes = {w.count(b" ") + 1 for w in windows}

    def clean(text):
        words = words_of(text.encode())
        return not any(b" ".join(words[i : i + m]) in windows for m in sizes for i in range(len(words) - m + 1))

    assert sorted(rows(stages[4])) == sorted(i for i, r in rows(stages[3]).items() if clean(r.text))


def test_tokens_and_run(spark, stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, of = rows(stages[5]), rows(stages[4])
    assert set(got) == set(of)
    assert all(r.ids == library.encode(of[i].text, add_special_tokens=False).ids for i, r in got.items())
    again = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert again == Counter((i, tuple(r.ids)) for i, r in got.items())


def test_decisions_are_those_of_the_operators(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score_documents(stages[0], labels)
    assert {r.doc_id for r in scored.where("keep").collect()} == set(rows(stages[1]))
    toxic = toxicity.add_toxicity(stages[1], toxicity.fit(stages[1], labels))
    assert {r.doc_id for r in toxic.where("toxicity.toxic < 0.5").collect()} == set(rows(stages[2]))
