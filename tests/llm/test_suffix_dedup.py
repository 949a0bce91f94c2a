import random

import numpy as np
import pytest
from brute import repeats

from riskloom.llm import suffix_dedup as S

COLS = ["_n_bytes", "_n_removed", "_n_spans", "_kept_sha256"]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = {r["n"]: tuple(r[c] for c in COLS) for r in S.remove_repeats(df, **kw).collect()}
    return [got[n] for n in range(len(rows))]


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé ñ") for _ in range(rnd.randint(2, 9)))
    line = "a shared line that very many of the documents hold, word for word, with no change at all"
    texts = [" ".join(word() for _ in range(rnd.randint(0, 90))) for _ in range(n // 2)]
    while len(texts) < n:
        t = rnd.choice(texts)
        k = rnd.randrange(len(t) + 1)
        texts.append(rnd.choice([t, t[:k] + "X" + t[k:], t[k:] + line, line + t, t[:k] + rnd.choice(texts), ""]))
    return texts


@pytest.mark.parametrize("hot_limit", [1 << 17, 3])
def test_matches_brute_force(spark, hot_limit):
    texts = corpus(1)
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    rows = list(zip(ids, texts)) + [(7, None), (None, texts[0]), (None, texts[1] + texts[2]), (3, texts[5]), (3, texts[5]),
                                    (500, "z" * 3000), (501, "z" * 120), (502, "q" * 49), (503, "q" * 49)]
    want = repeats(rows, 50)
    assert sum(r[1] for r in want) > 3000
    assert run(spark, rows, segment_bytes=4000, hot_limit=hot_limit) == want


def test_table_and_long_text(spark, table):
    docs = [(r["doc_id"], r["text"]) for r in table("documents").select("doc_id", "text").collect()]
    docs += [(10**6, "".join(t for _, t in docs[:80])), (10**6 + 1, "x" + "".join(t for _, t in docs[40:120]))]
    assert run(spark, docs) == repeats(docs, 50)


def test_text_spans_and_clashing_names(spark):
    a = "é" * 40 + "tail"
    df = spark.createDataFrame([(1, a, 5, "s"), (2, "start" + a, 6, "t")], "doc_id int, text string, seg int, `a.b` string")
    out = {r["doc_id"]: r for r in S.remove_repeats(df).collect()}
    assert out[1]["_kept"] == a and out[1]["_spans"] == [] and out[1]["a.b"] == "s" and out[2]["seg"] == 6
    assert out[2]["_kept"] == "start" and out[2]["_spans"] == [5, 5 + len(a.encode())]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0


def test_rounds_are_sorted_suffixes_with_their_common_prefixes():
    rnd = np.random.default_rng(0)
    x = rnd.integers(97, 99, (40, 12), dtype=np.uint8)
    group = np.sort(rnd.integers(0, 4, 40))
    for col, order, lcp in S.column_rounds(group, x, 6):
        rows = [(group[i], x[i, col:].tobytes()) for i in order]
        assert rows == sorted(rows)
        for k in range(1, 40):
            a, b = rows[k - 1][1], rows[k][1]
            common = next((n for n, (p, q) in enumerate(zip(a, b)) if p != q), len(a))
            assert lcp[k] == (min(common, 6) if rows[k - 1][0] == rows[k][0] else 0)


def test_rounds_decide_equal_strings_under_one_key():
    rng = np.random.default_rng(9)
    x = rng.integers(97, 99, (300, 6)).astype(np.uint8)
    key, ids = rng.integers(0, 3, 300), rng.integers(0, 200, 300)
    want = [int(any(key[a] == key[b] and (x[a] == x[b]).all() and ids[b] < ids[a] for b in range(300))) for a in range(300)]
    assert S.marks(key, x, ids, 6, settle=False).tolist() == S.marks(key, x, ids, 6).tolist() == want
    assert S.marks(key[:0], x[:0], ids[:0], 6, settle=False).tolist() == []


def test_no_table_is_left_in_the_catalogue(spark):
    df = spark.createDataFrame([(i, f"{i % 3} " * 40) for i in range(9)], "doc_id long, text string")
    before = spark.catalog.listTables()
    out = S.remove_repeats(df)
    assert spark.catalog.listTables() == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert out.count() == 9
