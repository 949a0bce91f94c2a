"""Merkle manifest, ranked lexical search and personal data against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from brute import words
from pyspark.sql import functions as F

from riskloom.llm import lexical_search as L
from riskloom.llm import merkle_manifest as M
from riskloom.llm import personal_data as P
from riskloom.llm import queries as Q


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# -- Merkle manifest -------------------------------------------------------

def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes, fan_out):
    layers = [hashes]
    while len(layers[-1]) > 1:
        cur = layers[-1]
        layers.append([sha("".join(cur[i:i + fan_out])) for i in range(0, len(cur), fan_out)])
    return layers


def fold(layers, i, claim, fan_out):
    sibs = []
    for layer in layers[:-1]:
        a = i - i % fan_out
        run = layer[a:a + fan_out]
        sibs += run[:i - a] + run[i - a + 1:]
        run[i - a] = claim
        claim, i = sha("".join(run)), i // fan_out
    return claim, sibs


def manifest(rows, claims, fan_out=8):
    """rows (doc_id, source, lang, n_chars, text) and claimed leaves -> sorted result rows."""
    groups = {}
    for r, c in zip(rows, claims):
        groups.setdefault(r[2], []).append((r[0], leaf_of(r), c))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]], fan_out)
    top = tree([trees[g][-1][0] for g in order], fan_out)
    out = []
    for k, g in enumerate(order):
        for i, (doc, leaf, claim) in enumerate(groups[g]):
            h, low = fold(trees[g], i, claim or leaf, fan_out)
            h, high = fold(top, k, h, fan_out)
            out.append((doc, leaf, trees[g][-1][0], top[-1][0], sha("".join(low + high)), h, h == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, block int, `a.b` int"


def check_manifest(spark, rows, claims, **kw):
    df = spark.createDataFrame([(*r, c, "x", 1, 2) for r, c in zip(rows, claims)], SCHEMA)
    got = M.manifest(df, claim=F.col("leaf"), **kw)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == manifest(rows, claims, kw.get("fan_out", 8))


def some_rows(rnd, n, langs):
    return [(rnd.randrange(10 ** 18), rnd.choice(["s", None, ""]), rnd.choice(langs), rnd.choice([None, 3, -1]),
             rnd.choice([None, "", "Aé", "日本", "x" * rnd.randrange(50)])) for _ in range(n)]


def test_manifest_brute_force(spark):
    rnd = random.Random(5)
    rows = some_rows(rnd, 300, ["en"] * 12 + ["é", "z", "Z", "", None]) + [(1, "s", "alone", 1, "t")]
    rows += [rows[0]] * 20 + [(rows[0][0], "other", "en", 1, "u"), (None, None, None, None, None), (None, "s", "en", 1, "A" * 300_000)]
    claims = [rnd.choice([None, sha("no")]) for _ in rows]
    check_manifest(spark, rows, claims)
    # Blocks of two levels of two: several tiers in both trees.
    check_manifest(spark, rows, claims, fan_out=2, block_levels=2)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65])
def test_manifest_edges(spark, n):
    rows = [(i, "s", "en", 1, "Text") for i in range(n)]
    check_manifest(spark, rows, [None] * n, block_levels=1)


def test_manifest_proofs_fold(spark):
    rows = some_rows(random.Random(2), 40, ["a", "b", None])
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in M.manifest(df, with_proof=True).collect():
        h = r["leaf"]
        for p in r["proof"]:
            h = sha(p["left"] + h + p["right"])
        assert h == r["root"] and r["verified"]


def test_manifest_query(spark, table, tmp_path):
    rows = [tuple(r[c] for c in M.COLUMNS) for r in table("documents").collect()]
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    claims = [leaf_of((*r[:4], low(r[4]))) if zlib.crc32(str(r[0]).encode()) % 3 == 0 else None for r in rows]
    from brute import SMALL
    got = sorted((tuple(r) for r in Q.op11_merkle_dataset_manifest(spark, SMALL).collect()), key=repr)
    assert got == manifest(rows, claims) and {r[-1] for r in got} == {True, False}


# -- ranked lexical search --------------------------------------------------

def search(docs, items, k=20):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    big_n, big_l = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 75 + 25 * n * big_n // big_l
            s = sum(r * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, r in Counter(words(text)).items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def check_search(spark, docs, items, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string")
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, rank int")
    got = sorted((tuple(r) for r in L.search(df, it, **kw).collect()), key=repr)
    want = search(docs, items, kw.get("k", 20))
    assert got == want
    return got


def corpus(seed=4):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "日本", "9", "Zz"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    docs = [(rnd.randrange(10 ** 15), text(rnd.randrange(80))) for _ in range(60)]
    docs += [(i, docs[3][1]) for i in range(40)] + [(5, "w1 w2")] * 30 + [(5, "w1"), (None, "w1 w2"), (None, docs[3][1])]
    docs += [(-1, None), (-2, ""), (-3, "--"), (-4, "w1 w3 " * 2000)]
    items = [(str(i), text(rnd.randrange(1, 30))) for i in range(20)] + [("n", None), ("e", ""), ("u", "nothing here"), (None, "w1 w1 w3")]
    return docs, [*items, items[2], ("3", "w5"), ("s", "w1 w2 " * 50)]


def test_search_brute_force(spark):
    docs, items = corpus()
    assert len(check_search(spark, docs, items)) > 200
    check_search(spark, docs, items, k=3)


def test_search_in_blocks_and_tiles(spark, monkeypatch):
    docs, items = corpus(6)
    monkeypatch.setattr(L, "TILE_ITEMS", 4)
    check_search(spark, docs, items, block_bytes=8000)  # several blocks, some items in two of them
    check_search(spark, docs, items[-3:], block_bytes=150, k=2)  # every item in several


def test_search_long_text_in_pieces(spark):
    docs = [(1, "ab " * 500_000 + "cd"), (2, "x" * 1_500_000 + " ab"), (3, "cd ab")]
    check_search(spark, docs, [("a", "ab cd"), ("b", "x" * 1_500_000)])


def test_search_empty_tables(spark):
    assert check_search(spark, [], [("a", "w1")]) == []
    assert check_search(spark, [(1, "w1")], []) == []
    assert check_search(spark, [(1, None)], [("a", "w1")]) == []


def test_item_tiles_bound_their_sums():
    import numpy as np
    rng = np.random.default_rng(1)
    row, term = np.divmod(np.unique(rng.integers(0, 5 * 40, 120)), 40)
    rep = rng.integers(1, 700_000, len(row))
    tile = L.ItemTile(row, term, rep, 5, 50)
    for a, b in zip(tile.cuts[:-1], tile.cuts[1:]):
        q = slice(tile.begin[a], tile.begin[b])
        assert np.bincount(tile.row[q], tile.repeats[q]).max() <= L.TILE_REPEATS and b - a <= L.TILE_TERMS
    t, d = np.divmod(np.unique(rng.integers(0, 50 * 7, 200)), 7)
    impact = rng.integers(1, 44_000 * 10 ** 6, len(t))
    want = [[sum(int(r) * int(x) for w, r in zip(term[row == i], rep[row == i]) for y, x in zip(t[d == j], impact[d == j]) if w == y)
             for j in range(7)] for i in range(5)]
    assert tile.scores(t, d, impact, 7).tolist() == want


# -- personal data -----------------------------------------------------------

def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    """The contract's expressions as they stand."""
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for kind, pattern, ok in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text or "") if ok(m)]
    return out


PIECES = ["a@b.co", "x.y+z@mail.example.com", "@", ".", "_d", "%", "a@b", "1.2.3.4", "256.1.1.1", ".5", "007.0.0.255", "4111 1111 1111 1111",
          "4111111111111111", "4111-1111-1111-1112", "5500 0000 0000 0004", "0", "12", " ", "  ", "-", "--", "+1 (234) 555-7890", "+49 30 123456",
          "+1", "+", "(", ")", "é", "日本", "\n", "1", "DE89 3704 0044 0532 0130 00", "ssn 078-05-1120", "378282246310005"]


def test_base_spans_brute_force():
    rnd = random.Random(9)
    for _ in range(6000):
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 14)))
        assert [(x.kind, x.start, x.end) for x in P.text_spans(t) if x.base] == base_spans(t), t


def test_spans_of_the_method():
    kinds = lambda t: [(x.kind, t[x.start:x.end]) for x in P.text_spans(t) if not x.base]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert kinds("DE89370400440532013001 XX89370400440532013000 DE8937040044053201300") == []
    assert kinds("my SSN is 078-05-1120") == [("ssn", "078-05-1120")] and kinds("078-05-1120") == [] == kinds("ssn 000-05-1120")
    assert kinds("NIR 2 55 08 14 168 025 38") == [("nir", "2 55 08 14 168 025 38")] and kinds("NIR 2 55 08 14 168 025 39") == []
    assert kinds("DNI 12345678Z, NIE X1234567L") == [("dni", "12345678Z"), ("dni", "X1234567L")] and kinds("DNI 12345678A") == []
    assert kinds("12 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")] == kinds("4111 1111 1111 1111 99")
    assert kinds("4111111111111111 5500000000000005") == [("card", "4111111111111111")]
    assert kinds("test order 12 4111 1111 1111 1111") == []


def test_scores_follow_the_words_nearby():
    of = lambda t: P.text_spans(t)[0].score
    assert of("+1 234 555 7890") == 0.6 and of("call +1 234 555 7890") == 0.9 and of("+1 234 555 7890" + " " * 30 + "call") == 0.6
    assert of("sample 4111111111111111") == 0.5 and of("Visa 4111111111111111") == 1.0
    assert of("x" * 50 + " call " + " " * 60 + "+1 234 555 7890") == 0.6


def test_long_periodic_texts_take_linear_time():
    import time
    t0 = time.time()
    for x in ("a", "1", "1 ", "1.", "a@", "+1", "+1 ", "1-", "a.", "DE89 ", "@", "1.1.1.1 ", "a@b.c_", "(", "DE893704"):
        P.text_spans(x * (1_000_000 // len(x)))
    assert time.time() - t0 < 60


def test_personal_data_rows(spark):
    docs = [(1, "a@b.co 1.2.3.4"), (2, None), (3, ""), (None, "call +1 234 555 7890"), (1, "a@b.co 1.2.3.4"), (4, "é日 a@b.co"), (5, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, spans int, id string")
    out = P.redact(df)
    assert out.columns == ["doc_id", "spans", "redacted"]
    got = sorted((r["doc_id"], [tuple(s)[:3] for s in r["spans"]], r["redacted"]) for r in out.collect() if r["doc_id"] is not None)
    two = [("email", 0, 6), ("ip", 7, 14)]
    assert got == [(1, two, "<email> <ip>"), (1, two, "<email> <ip>"), (2, [], None), (3, [], ""), (4, [("email", 3, 9)], "é日 <email>"), (5, [], "x" * 100_000)]
    assert P.personal_data(df.limit(0)).collect() == []


def test_personal_data_query(spark, table):
    from brute import SMALL
    texts = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    rows = Q.op13_pii(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = base_spans(texts[r["doc_id"]])
        n = Counter(x[0] for x in base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(n[k] for k in P.BASE)
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(base)
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s[0]), int(s[1])))
    assert sum(r["n_email"] + r["n_card"] for r in rows) > 10
