"""The whole pipeline against plain computations of its five stages."""

import os
from collections import defaultdict

import numpy as np
from brute import SMALL, classes, contamination, kept_bytes, simhash, token_ids, toxicity, without_repeats

import corpus_pipeline as P
from riskloom.llm import compression_toxicity as C
from riskloom.llm.tokens import tokenizer_path


def planted(docs, items):
    """Copies, a near copy, benchmark passages, a passage of three documents, odd texts."""
    first = max(docs, key=lambda r: len(r[1] or ""))[1]
    passage = " ".join(f"shared{i} passage{i * 7}" for i in range(60))
    alone = [" ".join(f"word{i * k} said" for i in range(1, 120)) for k in (3, 5, 7)]
    item = max((t for _, t in items if t), key=len)
    texts = [first, first, first + " end", item, alone[0] + " " + item + " " + alone[1], *(f"{a} {passage} {a[::-1]}" for a in alone),
             None, "", "", "short", "é" * 4000]
    return [(10**6 + i, t) for i, t in enumerate(texts)]


def test_run_equals_plain_stages(spark, table, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in table("documents").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    rows += planted(rows, items)
    data = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], table("documents").schema)
    data.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        os.symlink(f"{SMALL}/{name}.parquet", f"{tmp_path}/{name}.parquet")

    model = C.fit_from_tables(data, table("labels"))
    clean = [(i, t) for i, t in rows if toxicity(t, model) < P.TOXIC_SCORE]
    assert len(clean) < len(rows)

    prints = [simhash(t) for _, t in clean]
    keys = [i for i, _ in clean]
    single = [r for r, k in zip(clean, classes(keys, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)) if r[0] == k]
    assert len(single) <= len(clean) - 3

    cut = [(i, kept_bytes(raw, gone).decode(errors="ignore") if any(gone) else t)
           for (i, t), (raw, gone) in zip(single, without_repeats(single, 50))]
    assert sum(a != b for a, b in zip(single, cut)) >= 2

    left = [r for r, c in zip(cut, contamination(cut, items)) if not c[4]]
    assert len(left) < len(cut)

    got = defaultdict(list)
    for r in P.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {k: sum((ids for _, ids in sorted(v)), []) for k, v in got.items()} == dict(
        zip([i for i, _ in left], token_ids([t for _, t in left], tokenizer_path())))
