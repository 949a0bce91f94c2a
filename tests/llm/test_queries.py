"""The registered queries over whole tables at sf0.001: those with SQL agree
with it, all have their contract's columns and one row per document or vector."""

import duckdb
import pytest
from brute import SMALL, contamination, repeats, simhash, token_ids

import __spark_entry__ as E
from riskloom.llm import queries as Q
from riskloom.llm.tokens import tokenizer_path

COLUMNS = {
    "op2_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_token_id_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_merkle_dataset_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_registered():
    assert {k for k in E.queries() if k == "pipeline" or k[:2] == "op" and k[2].isdigit()} == {*Q.QUERIES, "pipeline"}


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    cur = con.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([norm(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == sorted(repr([norm(dict(zip(names, r))[c]) for c in sorted(names)]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns_and_rows(spark, name):
    df = E.queries()[name](spark, SMALL)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    table, key = ("embeddings", "vec_id") if name.startswith("op4") else ("documents", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect())
    rows = df.collect()
    if name == "op5_packing":
        assert sorted({r["doc_id"] for r in rows}) == ids
    else:
        assert sorted(r[key] for r in rows) == ids
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    by = {r[key]: r for r in rows}
    if name.startswith("op2"):
        assert [tuple(by[i])[1:] for i, _ in docs] == repeats(docs, 50)
    if name.startswith("op3"):
        items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
        assert [tuple(by[i])[1:] for i, _ in docs] == contamination(docs, items)
    if name.startswith("op7"):
        assert all(by[i]["fingerprint"] == f"{simhash(t):016x}" for i, t in docs)
    if name.startswith("op6"):
        size = [len(t) for t in token_ids([t for _, t in docs], tokenizer_path())]
        assert [by[i]["n_tokens"] for i, _ in docs] == size
