import random
import re
import zlib
from collections import Counter

from driftfield.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least_length=7, least_count=2):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            p = h % len(run)
            c[run[:p] + run[p + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in c.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def brute(words, ratio=10):
    out = {}
    for w, n in words.items():
        others = [(-words[o], o) for o in words if o != w and near(w, o)]
        form = min(others)[1] if others and -min(others)[0] >= ratio * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return sorted((w, *r) for w, r in out.items())


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()))


def made(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "r") for i, t in rows], "doc_id long, text string, word string, n int, rest string").repartition(4)


def test_all_pairs_chains_and_ties(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(7, 8))) for _ in range(400)] + ["aaaaaaa", "aaaaaaaa", "Éèêÿaaa", "éèêÿaaa", "×÷×÷×÷×"]
    chain = ["kkkkkkkx"] * 2 + ["kkkkkkk"] * 30 + ["kkkkkky"] * 400
    text = words + [rng.choice(words) for _ in range(900)] + chain + ["zzzzzzzz"] * 50 + ["zzzzzzzy"] * 50 + ["zzzzzzzx"] * 2
    rng.shuffle(text)
    rows = [(i if i % 7 else None, " ".join(text[i::40]).upper() if i % 3 else "-".join(text[i::40])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "short words only"), (5, "repeated REPEATED words"), (5, "repeated REPEATED words")]
    want = brute(counted(rows))
    assert got(spelling.group_variants(made(spark, rows))) == want
    assert any(r[1] and r[1] != r[2] for r in want) and max(r[4] for r in want) >= 5


def test_long_words_meet_each_other_and_short_ones(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcé") for _ in range(64))
    words = [base, base + "x", base[:30] + "q" + base[30:], base + "xy", base + "xz", base + "xyz", base[:-1] + "q", "a" * 66, "a" * 67, "a" * 65, "a" * 64, "b" + "a" * 66, "xy" * 2000, "xy" * 1999 + "xx", "xy" * 1999 + "x"]
    counts = {w: 2 + 30 * (i % 3 == 0) + i for i, w in enumerate(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert got(spelling.variants(df)) == brute(counts)


def test_empty_tables_and_missing_texts(spark, none):
    assert got(spelling.group_variants(none)) == []
    assert got(spelling.group_variants(made(spark, [(1, None), (2, " \n")]))) == []


def test_query_equals_brute_force(spark):
    from driftfield.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = counted(rows)
    result = {r.word: r for r in queries.op11_spelling_variants(spark, folder).collect()}
    assert {w: r.n for w, r in result.items()} == want
    some = dict(sorted(want.items())[::40])
    assert {w: result[w].n_near for w in some} == {w: sum(near(w, o) for o in want) for w in some}


def test_sql_twin(spark):
    import duckdb

    from driftfield.llm import queries

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{folder}/documents.parquet'")
    assert sorted(duckdb.sql(f"select word, form, root, n, n_near, form_n from ({queries.oracle_sql()['op11_spelling_variants']})").fetchall()) == got(queries.op11_spelling_variants(spark, folder))
