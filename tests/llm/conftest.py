import pytest

#: Null, empty, blank, short and odd texts; copies; and columns whose names operators use inside.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it " * 5), (2, "the quick brown fox jumps over the lazy dog and runs away from it " * 5), (3, None), (4, ""), (5, " \n\t "),
    (6, "one"), (7, "Ünïcode wörds 日本語テキスト 🙂 <|endoftext|> <s> don't  two   spaces\n\nlines\r\n\x00end"), (8, "aaaa" * 5000), (9, " ".join(f"w{i}" for i in range(3000))),
    (None, "a text without an id, which has some words in it"), (10, "▁ ▁▁ a ▁b"), (10, "▁ ▁▁ a ▁b"), (12, "x\n" * 60),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "key", 1, "rep", 0.5, "comp", "chunk") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n int, rep string, score double, comp string, chunk string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(df, *cols):
    return sorted(((r.doc_id is None, r.doc_id), *[r[c] for c in cols]) for r in df.collect())
