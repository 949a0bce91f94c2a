"""Packing, token files, embeddings, toxicity, dialogues and the pipeline."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import SMALL, classes, crc, token_ids

import corpus_pipeline

from riskloom.llm import chat_views as V
from riskloom.llm import compression_toxicity as T
from riskloom.llm import embedding_dedup as E
from riskloom.llm import packing as P
from riskloom.llm import rans_store as R
from riskloom.llm.tokens import Encoder, tokenizer_path

ODD = [(None, "null id"), (900, None), (901, ""), (902, " \n"), (903, "a b \x1c c d é Σίσυφος <|endoftext|> it's 42"), (904, "x" * 9000),
       (905, "word " * 6000), (7, "again"), (7, "again")]


@pytest.fixture(scope="module")
def docs(table):
    return [(r["doc_id"], r["text"]) for r in table("documents").limit(120).collect()] + ODD


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, ids int, sequence_id string")


# -- tokens and packing ----------------------------------------------------

def test_encoder_equals_tokenizer(docs, monkeypatch):
    texts = [t for _, t in docs] + ["a\x01b \x01 c", "x" * 16 + " " + "x" * 17, "é" * 8 + "\x00", "\x00 a\x00", "end",
                                    "Ab12c,d. don't DON'T a'b'' <|ENDOFTEXT|> x<|endoftext|>y A|b|| É3é× e\u0301E\u0301x ÷3 \u00c3 naïve—dash «q» 日本x1 K\u212a ß.ÀÖØÿ!?", "A", " a", "b "]
    enc = Encoder(tokenizer_path())
    for _ in range(2):
        ids, off = enc.encode(pa.array(texts), 1)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == token_ids(texts, tokenizer_path())
    monkeypatch.setattr("riskloom.llm.tokens.CACHE_ENTRIES", 50)
    ids, off = enc.encode(pa.array(texts[::-1]), 1)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == token_ids(texts[::-1], tokenizer_path())
    assert enc.encode(pa.array([], pa.string()), 1)[0].tolist() == []


def test_a_text_of_more_words_than_the_table_holds(monkeypatch):
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = ["", " ".join(words[:300]), "", " ".join(words[100:]) + "x" * 30, "end", ""]
    monkeypatch.setattr("riskloom.llm.tokens.CACHE_ENTRIES", 50)
    enc, used, insert = Encoder(tokenizer_path()), [], Encoder._insert
    monkeypatch.setattr(Encoder, "_insert", lambda self, *a: (insert(self, *a), used.append(int((self.size > 0).sum()))))
    ids, off = enc.encode(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == token_ids(texts, tokenizer_path())
    assert used and max(used) <= 50  # a full table would never be left


def test_packing(spark, docs):
    want = token_ids([t for _, t in docs], tokenizer_path())
    out = P.pack_documents(frame(spark, docs).repartition(2), with_ids=True).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append(r)
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and crc(ids) == r["ids_crc32"]
    pad = 0
    for rs in seqs.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:k]) for k in range(len(rs))]
        n = sum(r["length"] for r in rs)
        assert n <= 2048
        pad += 0 if n & (n - 1) == 0 else 2048 - n
    assert pad <= 0.03 * sum(map(len, want))
    pieces = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, ids in ((i, w) for (i, _), w in zip(docs, want) if i != 7):
        rs = pieces[i]
        assert [r["start"] for r in rs] == [sum(x["length"] for x in rs[:k]) for k in range(len(rs))]
        assert b"".join(r["ids"] for r in rs) == np.array(ids, "<u4").tobytes() and all(r["doc_tokens"] == len(ids) for r in rs)
    assert P.pack_documents(frame(spark, [])).count() == 0


def cheapest(places, penalty, window):
    best = [0] + [math.inf] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= window:
                best[j] = min(best[j], best[i] + window - n + penalty[j])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_choose_cuts_is_optimal(seed):
    rnd = random.Random(seed)
    window = 64
    places = np.cumsum([0] + [rnd.randint(1, 20) for _ in range(60)])
    penalty = np.array([rnd.choice([0, 2, 9]) for _ in places])
    best = cheapest(places.tolist(), penalty.tolist(), window)
    at = dict(zip(places.tolist(), penalty.tolist()))
    for close in (True, False):
        cuts = [0] + P.choose_cuts(places, penalty, window, close)
        lens = np.diff(cuts)
        assert (lens > 0).all() and (lens <= window).all()
        cost = sum(window - n + at[c] for n, c in zip(lens.tolist(), cuts[1:]))
        if close:
            assert cuts[-1] == places[-1] and cost == best[-1]
        else:
            assert places[-1] - cuts[-1] < window and cost == min(b for b, p in zip(best, places) if p > max(0, places[-1] - window))


# -- token files -----------------------------------------------------------

@pytest.mark.parametrize("n", [1, 15, R.CHECK, R.BLOCK, R.BLOCK + 1, 3 * R.BLOCK - 7])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49407).astype(np.uint32)
    table = R.Table(R.quantise(np.bincount(ids, minlength=49408)))
    assert int(table.freq.sum()) == 1 << R.SCALE and table.freq.min() >= 1
    blocks = R.encode_blocks(ids, table)
    assert (R.decode_blocks(blocks, table) == ids).all()
    assert (R.decode_blocks(blocks[-1:], table) == ids[(len(blocks) - 1) * R.BLOCK:]).all()
    bad = bytearray(blocks[0])
    bad[-1 if n > R.LANES else 40] ^= 1
    if n == R.BLOCK:
        with pytest.raises(ValueError):
            R.decode_blocks([bytes(bad)], table)
    with pytest.raises(ValueError):
        R.decode_blocks([blocks[0][:-4] if n > R.BLOCK else b"other" + blocks[0]], table)


def test_token_files(spark, docs, monkeypatch):
    path = R.Scratch(spark, "t").path()
    R.write_token_files(frame(spark, docs).repartition(3), path)
    got = R.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    want = token_ids([t for _, t in docs], tokenizer_path())
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, len(want[k])))
    assert [r["id"] for r in got] == [docs[k][0] for k in order]
    start = 0
    for r, k in zip(got, order):
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(want[k]), crc(want[k]), want[k])
        start += len(want[k])
    assert R.store_and_read(frame(spark, [])).count() == 0


# -- embeddings ------------------------------------------------------------

def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    vecs = [base[rng.integers(40)] + rng.normal(size=8) * rng.choice([0, .02, .1, .15, .3]) for _ in range(500)]
    vecs += [v * 1e200 for v in vecs[:3]] + [v * 1e-200 for v in vecs[3:6]] + [vecs[0]] * 30
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    rows += [(700, None), (701, []), (702, [0.0] * 8), (703, [1.0] * 7 + [None]), (704, [1.0] * 7 + [math.inf]), (705, [math.nan] * 8),
             (706, [1.0] * 4), (707, [2.0] * 4), (708, [1.0, -0.0]), (709, [2.0, 0.0]), (None, vecs[1].tolist()), (None, [9.0] * 3), (702, [0.0] * 8)]
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if ok(v) else None for _, v in rows]
    cos = lambda a, b: float(a @ b / math.sqrt((a @ a) * (b @ b)))
    link = lambda a, b: unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and cos(unit[a], unit[b]) >= 0.95
    comp = classes([i for i, _ in rows], link)
    n = [sum(link(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    # Hosts of one cell in chunks; of several cells; one pass for each top cell.
    for kw in ({"cell_rows": 60, "block": 32}, {"cell_rows": 5, "block": 64, "slice_bytes": 4000}, {}):
        out = E.near_vectors(df, **kw).collect()
        got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in out)
        assert got == sorted((str(i), k, str(c), i == c) for (i, _), k, c in zip(rows, n, comp))
    assert E.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_single_precision(spark):
    rng = np.random.default_rng(16)
    base = rng.normal(size=(30, 6))
    x = np.array([base[rng.integers(30)] + rng.normal(size=6) * .12 for _ in range(400)]).astype(np.float32)
    x[5], x[6] = x[7], -x[7]
    wide = x.astype(float)
    cos = (wide @ wide.T) / np.outer(np.linalg.norm(wide, axis=1), np.linalg.norm(wide, axis=1))
    near = cos >= 0.95
    comp = classes(list(range(400)), lambda a, b: bool(near[a, b]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for kw in ({"cell_rows": 10, "block": 40, "slice_bytes": 1000}, {"cell_rows": 3, "block": 400}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df, **kw).collect()}
        assert got == {i: (int(near[i].sum()) - 1, comp[i]) for i in range(400)}


def test_cells_grow_with_the_rows():
    rng = np.random.default_rng(3)
    tops = E._unit(rng.normal(size=(4, 6)))
    cells = {t: (E._unit(tops[t] + rng.normal(size=(5, 6)) * .2), np.full(5, .3), np.arange(5) // 2 + 10 * t) for t in range(4)}
    x = E._unit(tops[rng.integers(4, size=200)] + rng.normal(size=(200, 6)) * .2)
    home = (x @ tops.T).argmax(1)
    leaf = np.array([(h << 16) + (cells[h][0] @ v).argmax() for h, v in zip(home, x)])
    whole = E._visits(leaf, x, (tops, np.full(4, .6)), cells, .3).to_pylist()
    parts = [E._visits(leaf, x, (tops, np.full(4, .6)), {t: cells[t]}, .3).to_pylist() for t in range(4)]
    assert whole == [sum((p[k] for p in parts), []) for k in range(200)]
    for k, row in enumerate(whole):
        assert [v["host"] for v in row if not v["guest"]] == [cells[home[k]][2][leaf[k] & 0xFFFF]]
        assert all(c > leaf[k] and cells[c >> 16][2][c & 0xFFFF] == v["host"] for v in row for c in v["cells"])
    assert list(E._slices([(0, 3), (2, 3), (3, 9), (7, 1)], 6)) == [(0, 2), (3, 3), (7, 7)]


# -- toxicity --------------------------------------------------------------

def test_toxicity_held_out(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rnd.randint(1, 4)))
    bad = ["idiotic", "moronish", "scumbag", "worthless"]
    rows = []
    for i in range(900):
        w = [word() for _ in range(rnd.randint(20, 200))]
        y = int(rnd.random() < .25)
        for _ in range(3 * y):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad).upper() if rnd.random() < .3 else rnd.choice(bad))
        rows.append((i, " ".join(w), y))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, "the", 0.5), (2000, None, 0.5), (2001, "", 0.5), (2002, "q" * 5000, 0.5), (5, rows[5][1], .5)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (2001, None), (1, rows[1][2])], "doc_id long, toxic int")
    model = T.fit_from_tables(docs, labels)
    assert model == T.fit_from_tables(docs.repartition(3), labels)
    out = T.score_documents(docs, model).withColumn("held", T.is_held_out()).collect()
    assert len(out) == 905 and all(0 <= r["score"] <= 1 for r in out)
    score = {r["doc_id"]: r["score"] for r in out}
    held = {r["doc_id"] for r in out if r["held"]}
    test = [(score[i], y) for i, _, y in rows if i in held]
    assert len(test) > 150 and sum((s >= .3) == bool(y) for s, y in test) >= 0.95 * len(test)
    kept = T.keep_below(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.3 for r in out)
    assert T.score_documents(docs.limit(0), model).count() == 0


def test_toxic_passages_of_common_words():
    """Toxic text that no word gives away: the same words, in fixed passages."""
    rnd = np.random.default_rng(3)
    vocabulary = np.array(["".join(rnd.choice(list("abcdefghijklmnop"), 5)) for _ in range(60)])
    say = lambda k: " ".join(rnd.choice(vocabulary, k))
    passages = [say(30) for _ in range(12)]
    text = lambda y: " ".join([say(40), passages[rnd.integers(12)] if y else say(30), say(40)])
    y = [k % 2 for k in range(800)]
    model = T.fit([text(k) for k in y], y)
    score = 1 / (1 + np.exp(-T.evidence(*T.savings([text(k) for k in y], model.compressors())) @ np.array(model.weights)))
    assert np.mean((score >= 0.5) == np.array(y)) >= 0.9


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_toxicity_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    model = T.fit_from_tables(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in T.score_documents(docs, model).collect())


# -- dialogues -------------------------------------------------------------

def test_perspectives(spark):
    rnd = random.Random(9)
    rows = [(1, k, rnd.choice(["ann", "bob", "cy"]), f"turn {k} <|end|>") for k in range(150)]
    rows += [(2, 0, "system", "be kind"), (2, 1, None, None), (2, 1, "ann", "é"), (2, 1, "ann", "é"), (None, 3, "bob", "x"), (None, None, "ann", ""),
             (3, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, speaker string")
    got = {}
    for r in V.perspectives(df, chunk_turns=16, views_per_task=2).collect():
        assert r["n_turns"] <= 16
        said = [r["text"][m["start"]:m["end"]] for m in r["mask"]]
        assert r["n_masked"] == sum(map(len, said))
        got.setdefault((r["conv_id"], r["speaker"]), []).append((r["chunk"], r["text"], said))
    want = {}
    for c in (1, 2, 3, None):
        none = lambda v: (v is not None, v if v is not None else 0)
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (none(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        turns = [(r[2] or "unknown", (r[3] or "").replace("<|", "< |")) for r in turns]
        for s in {t[0] for t in turns} - {"system"}:
            head = lambda r: "assistant" if r == s else r if r == "system" else f"user name={r}"
            want[c, s] = ("".join(f"<|{head(r)}|>{t}<|end|>\n" for r, t in turns), [t for r, t in turns if r == s])
    assert {k: ("".join(t for _, t, _ in sorted(v)), [x for _, _, s in sorted(v) for x in s]) for k, v in got.items()} == want
    assert V.perspectives(df.limit(0)).count() == 0


# -- pipeline --------------------------------------------------------------

def test_pipeline_stages(spark, table):
    docs = table("documents")
    rows = [(10**6, "x", "en", None, None), (10**6 + 1, None, None, "s", 0), (None, "y " * 50, "en", "s", 100)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        docs = corpus_pipeline.Scratch(spark, "t").write(out)
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] >= counts[4] > 100
    assert counts[2] < counts[0]
    final = corpus_pipeline.run(spark, SMALL)
    assert final.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
