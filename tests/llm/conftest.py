import pytest

# Texts that every operator must take: null, empty, blanks, very long, repeated, other scripts.
HARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "word " * 30_000),
    (5, "Ünïcödé — 日本語のテキスト İß́ 🙂 \x00 end"),
    (6, "same text here for ties and nothing else"),
    (6, "same text here for ties and nothing else"),
    (7, "same text here for ties and nothing else"),
    (None, "a row without an id"),
    (8, "x" * 50_000),
]
SCHEMA = "doc_id bigint, text string"
# Columns that clash with names the operators use inside or return.
CLASHING = "doc_id bigint, text string, fingerprint string, part int, n_words string, arrival int, root int, evidence int, toxicity int, shard int, media int, ids int, contamination int, licenses int"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    n = CLASHING.count(",") - 1
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in HARD], CLASHING)
