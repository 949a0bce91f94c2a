"""Decontamination, SimHash, licence and sharding operators against brute force."""

import hashlib
import random
import textwrap

import numpy as np
import pytest
from brute import classes, contamination, simhash, words

from riskloom.llm import decontaminate as D
from riskloom.llm import extendible_sharding as X
from riskloom.llm import license_lookup as L
from riskloom.llm import simhash_index as H


def by_row(spark, rows, op, cols):
    """Apply ``op`` to (id, text) rows that carry clashing extra columns; results in input order need unique ids or equal rows."""
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, h int")
    got = {}
    for r in op(df).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    return got


# -- decontamination -------------------------------------------------------

C_COLS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def check_contamination(spark, docs, items):
    it = spark.createDataFrame(items, "item_id long, text string")
    got = by_row(spark, docs, lambda df: D.contamination(df, it), C_COLS)
    want = {}
    for (i, _), w in zip(docs, contamination(docs, items)):
        want.setdefault(i, []).append(w)
    key = lambda v: sorted(map(repr, v))
    assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in want.items()}
    return want


def test_contamination_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["É", "日本", "x9"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab).upper() if rnd.random() < .3 else rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 5, 13, 20, 40]))) for i in range(25)] + [(90, ""), (91, None), (None, text(4)), (92, "--")]
    items += [(93, items[4][1]), (4, text(15))]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(40)]
    for i in range(40, 70):
        a = items[rnd.randrange(25)][1]
        docs.append((i, f"{text(rnd.randint(0, 30))} {a} {text(rnd.randint(0, 30))} {a}"))
    docs += [(100, None), (101, ""), (102, "!!"), (7, docs[50][1]), (7, docs[50][1]), (None, docs[51][1]), (103, " ".join([docs[60][1]] * 40))]
    want = check_contamination(spark, docs, items)
    assert sum(w[4] for v in want.values() for w in v) > 10


def test_contamination_of_table(spark, table):
    docs = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    docs += [(9000 + i, f"{docs[i][1]} {t}") for i, t in items]
    check_contamination(spark, docs, items)


def test_contamination_empty_sides_and_filter(spark):
    docs = [(1, "a b c"), (2, "d e f g"), (2, "z z z")]
    check_contamination(spark, docs, [])
    check_contamination(spark, [], [(1, "a")])
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, n_hit string")
    it = spark.createDataFrame([(5, "d e f")], "item_id long, text string")
    kept = D.keep_clean(df, it)
    assert kept.columns == df.columns and sorted(r["text"] for r in kept.collect()) == ["a b c", "z z z"]


def test_spans(spark):
    df = spark.createDataFrame([(1, "x a b y A, b")], "doc_id long, text string")
    it = spark.createDataFrame([(5, "a b")], "item_id long, text string")
    r = D.contamination(df, it, spans=True).first()
    assert r["hit_spans"] == [[1, 2], [4, 2]] and r["n_hit"] == 4


# -- SimHash ---------------------------------------------------------------

def test_simhash_components(spark, table):
    docs = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    docs += [(300, None), (301, ""), (302, " \t "), (303, "One"), (304, "one"), (None, docs[3][1]), (5, docs[5][1]), (305, "a b"),
             (306, "\x1c b\x85 c d"), (307, docs[9][1] * 60)]
    docs += [(400 + i, docs[i][1] + " tail") for i in range(60)]
    fps = [simhash(t) for _, t in docs]
    comp = classes([i for i, _ in docs], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    want = {}
    for (i, _), f, c in zip(docs, fps, comp):
        want.setdefault(i, []).append((f"{f:016x}", c))
    got = by_row(spark, docs, H.simhash_components, ["fingerprint", "component_id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("limit", [40, 10**6])
def test_near_links_find_every_class(spark, limit):
    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(60)]
    flip = lambda f, n: f ^ sum(1 << b for b in rnd.sample(range(64), n))
    codes = sorted({flip(rnd.choice(centres), rnd.choice([0, 1, 2, 3, 4, 6])) for _ in range(900)} | {flip(centres[0], 2) for _ in range(300)})
    comp = classes(codes, lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 3)
    scratch = H.Scratch(spark, "t")
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = scratch.write(spark.createDataFrame([(c,) for c in signed], "fp long"))
    tree = {r["node"]: r["root"] for r in H.components(scratch, H.near_links(scratch, df, 3, limit, 200)).collect()}
    got = {}
    for c, s in zip(codes, signed):
        got.setdefault(tree.get(s, s), []).append(c)
    want = {}
    for c, k in zip(codes, comp):
        want.setdefault(k, []).append(c)
    assert sorted(got.values()) == sorted(want.values())


def test_gray_rank_orders_neighbours():
    n = np.arange(64, dtype=np.uint64)
    code = n ^ (n >> np.uint64(1))
    assert (H.gray_rank(code) == n).all()


def test_keep_representatives(spark):
    rows = [(4, "a b c d e f", "p"), (2, "A b  c d e f", "q"), (2, "A b  c d e f", "q"), (9, None, "r"), (8, "", "s"),
            (None, "x y z w", "t"), (None, "x y z w", "t"), (None, "a b c d e f", "u"), (6, "only one", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = H.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["fp"]) for r in kept.collect()) == [("2", "q"), ("6", "v"), ("8", "s"), ("None", "t")]
    assert H.keep_representatives(df.limit(0)).count() == 0


# -- licences --------------------------------------------------------------

def test_license_matches(spark):
    mit = L.MIT.upper().replace("COPIES", "copies").replace(" ", "  ")
    rows = [(1, "Copyright (c) 2020 Someone\n(C) 2021 Other\n\n" + mit), (2, "prose\nReleased under the MIT Licence\nmore\nLICENSED UNDER CC-BY-NC 4.0"),
            (3, None), (4, ""), (5, "..."), (6, L.MIT + " not"), (None, "released under the mit license"), (7, "Released under the MIT License." * 2)]
    got = by_row(spark, rows, lambda df: L.license_matches(df, L.known_licenses(spark)), ["text_license", "line_licenses", "n_license_lines"])
    assert got == {1: [("MIT", "", 0)], 2: [(None, "CC-BY-NC-4.0,MIT", 2)], 3: [(None, "", 0)], 4: [(None, "", 0)], 5: [(None, "", 0)],
                   6: [(None, "", 0)], None: [("MIT", "MIT", 1)], 7: [(None, "", 0)]}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert L.license_matches(df.limit(0), L.known_licenses(spark)).count() == 0
    none = L.license_matches(df, L.known_licenses(spark).limit(0))
    assert none.count() == len(rows) and none.filter("n_license_lines > 0").count() == 0


def rewrapped(text, width):
    """The text with its paragraphs filled anew."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in text.split("\n\n"))


def test_known_texts_at_any_wrap(spark):
    texts = [(n, t) for n, t in L.KNOWN if "\n" in t]
    head = "Copyright Somebody\n(c) 2021 Other\n\n"
    cases = [(n, head + rewrapped(t, w)) for n, t in texts for w in (*range(20, 121, 4), 10 ** 6)]
    # Only statements go from a body: these differ from the known texts.
    cases += [(None, t.replace("above copyright notice and ", "above and ")) for n, t in texts if n != "0BSD"]
    cases += [(n, t.replace("\n\n", "\n\nCopyright (c) 1999 A. Person\nAll rights reserved.\n\n", 1)) for n, t in texts]
    got = by_row(spark, [(k, t) for k, (_, t) in enumerate(cases)], lambda df: L.license_matches(df, L.known_licenses(spark)), ["text_license"])
    assert got == {k: [(n,)] for k, (n, _) in enumerate(cases)}


def test_published_texts(spark):
    keep = lambda p: any(" ".join(L.re.findall("[a-z0-9]+", x.lower())) in L.TITLES or L.re.search("copyright (.c. |.yyyy)", x.lower()) for x in p.split("\n"))
    wrap = lambda t, w: "\n\n".join(p if keep(p) else rewrapped(p, w) for p in t.split("\n\n"))
    published = [(n, t) for n, t in L.bodies()]
    assert len({n for n, _ in published}) == 12
    cases = [(n, wrap(t, w)) for n, t in published for w in (24, 61, 80, 10 ** 6)] + published
    who = "\nCopyright (c) 2024 Somebody\nAll rights reserved.\n\n"
    title = {"MIT": "MIT License\n", "ISC": "ISC License\n", "0BSD": "BSD Zero Clause License\n", "BSD-2-Clause": "BSD 2-Clause License\n",
             "BSD-3-Clause": "The 3-Clause BSD License\n", "Zlib": "zlib License\n", "Unlicense": "The Unlicence\n"}
    cases += [(n, title[n] + who + t) for n, t in L.KNOWN + published if n in title and "\n" in t]
    cases += [(None, "MIT License"), (None, "MIT License" + who), (None, "ISC License\n\nsomething else")]
    cases += [(None, t.replace("the", "no", 1)) for _, t in published]
    got = by_row(spark, list(enumerate(t for _, t in cases)), lambda df: L.license_matches(df, L.known_licenses(spark)), ["text_license"])
    assert {k: v for k, v in got.items() if v != [(cases[k][0],)]} == {} and len(got) == len(cases)
    own = spark.createDataFrame([("title", "The MIT License")], "license string, text string")
    got = by_row(spark, [(1, "The MIT License\n" + who), (2, "The MIT License\nx")], lambda df: L.license_matches(df, own), ["text_license", "line_licenses"])
    assert got == {1: [("title", "title")], 2: [(None, "title")]}


# -- sharding --------------------------------------------------------------

def test_shards_fit_and_split_only_when_needed(spark):
    rnd = random.Random(5)
    rows = [(i, "é" * rnd.randint(0, 40)) for i in range(400)] + [(900, "x" * 5000), (901, None), (None, "n" * 30)] + [(7, "hot" * 9)] * 120
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, depth int, prefix string")
    limit = 600
    out = X.assign_shards(df, ["doc_id"], "text", limit).collect()
    assert len(out) == len(rows)
    size = {}
    for r in out:
        size.setdefault((r["depth"], r["prefix"]), []).append(r)
    total = {}
    for (depth, prefix), rs in size.items():
        assert len(rs) == rs[0]["shard_rows"] and (rs[0]["shard_bytes"] <= limit or len(rs) == 1)
        for d in range(depth):
            k = (d, prefix >> (depth - d))
            b, n = total.get(k, (0, 0))
            total[k] = (b + rs[0]["shard_bytes"], n + len(rs))
    assert all(b > limit and n > 1 for b, n in total.values())
    assert sum(rs[0]["shard_bytes"] for rs in size.values()) == sum(len((t or "").encode()) for _, t in rows)
    home = {(r["depth"], r["prefix"]) for r in out if r["doc_id"] == 3}
    want = int(hashlib.md5(b"3").hexdigest()[:12], 16)
    assert all(want >> (48 - d) == p for d, p in home)
    assert X.assign_shards(df.limit(0), ["doc_id"], "text", limit).count() == 0


def test_hot_keys_split_until_they_fit(spark):
    rows = [(7, "hotrow")] * 6000 + [(None, "é" * 3)] * 5000 + [(8, "x" * 50), (9, None)]
    out = X.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["doc_id"], "text", 13).collect()
    size = {}
    for r in out:
        size.setdefault((r["depth"], r["prefix"]), []).append(r)
    assert len(out) == len(rows) and max(d for d, _ in size) > X.BITS
    for rs in size.values():
        assert len({(r["shard_bytes"], r["shard_rows"]) for r in rs}) == 1 and len(rs) == rs[0]["shard_rows"]
        assert sum(len((dict(rows)[r["doc_id"]] or "").encode()) for r in rs) == rs[0]["shard_bytes"]
        assert rs[0]["shard_bytes"] <= 13 or len(rs) == 1


def test_words_of_bytes():
    import pyarrow as pa

    texts = ["Ab-c É2_x", None, "", " 日本 z"]
    w = D.Words(pa.array(texts))
    assert [w.line(w.first[i], w.first[i + 1]).split() for i in range(4)] == [words(t) for t in texts]
