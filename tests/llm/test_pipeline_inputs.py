"""The pipeline's stages and the licence texts under odd inputs and installs."""

import os
import subprocess
import sys
import zipfile

import pytest
from brute import SMALL

import corpus_pipeline as C
from riskloom import session
from riskloom.llm import license_lookup as L

ODD = ["_gone", "_fp", "_rid", "_again", "_kept", "_n_removed", "a.b", "id", "c0", "row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)


def rows():
    base = " ".join(f"word{i} goes on" for i in range(40))
    texts = [(1, base), (2, base), (3, "another text " * 30 + base[:200]), (3, "other words entirely " * 9), (3, "other words entirely " * 9),
             (4, None), (5, ""), (None, "no id here, " * 8), (None, "no id here, " * 8), (6, "x" * 200_000)]
    return [(i, t, "en", "s", len(t or ""), *[f"{c}{n}" for c in ODD]) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def some_toxicity_model(spark, table):
    """The stage learns from labelled rows, so these are added to its input."""
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in table("documents").collect()]


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stage_keeps_odd_columns(spark, some_toxicity_model, name, stage):
    mine = rows()
    if name == "toxicity":
        mine += [(*r, *[None] * len(ODD)) for r in some_toxicity_model]
    df = spark.createDataFrame(mine, SCHEMA)
    out = stage(spark, df, SMALL)
    got = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in mine}
        return
    assert out.columns == df.columns
    kept = {r["a.b"]: r for r in got if r["a.b"]}
    for n, r in enumerate(mine[:len(rows())]):
        k = kept.get(f"a.b{n}")
        assert k is None or [k[c] for c in ODD] == list(r[5:]) and k["doc_id"] == r[0]
    if name == "toxicity":  # what a model of few rows says of these texts is open
        assert kept
    else:
        assert len(kept) == {"simhash_near_dedup": 6, "suffix_array_dedup": 10, "benchmark_decontamination": 10}[name]
    if name == "suffix_array_dedup":
        assert kept["a.b1"]["text"] == "" and kept["a.b1"]["n_chars"] == 0 and kept["a.b5"]["text"] is None


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stage_of_an_empty_table(spark, name, stage):
    df = spark.createDataFrame([], SCHEMA)
    out = stage(spark, df, SMALL)
    assert out.collect() == [] and (name == "packing" or out.columns == df.columns)


def test_licence_texts_from_a_zip(spark, tmp_path):
    session._SHIPPED.clear()
    before = set(spark.sparkContext._python_includes)
    session.ship_package(spark)
    made = [x for x in spark.sparkContext._python_includes if x.endswith("riskloom.zip")]
    assert made and before is not None
    from pyspark import SparkFiles
    path = SparkFiles.get(made[-1])
    assert sum(n.startswith("riskloom/llm/licenses/") for n in zipfile.ZipFile(path).namelist()) == len(L.PUBLISHED)
    code = "import riskloom.llm.license_lookup as L; print(L.__file__); print(len(L.bodies()))"
    env = {**os.environ, "PYTHONPATH": path}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120).stdout.split()
    assert out[0].startswith(path) and int(out[1]) == len(L.bodies()) > len(L.PUBLISHED)


def test_missing_licence_text_is_an_error(monkeypatch):
    monkeypatch.setattr(L, "PUBLISHED", [*L.PUBLISHED, "No-Such-1.0"])
    with pytest.raises(FileNotFoundError):
        L.bodies()


def test_dotted_names(spark):
    from riskloom.llm import embedding_dedup, packing, rans_store
    df = spark.createDataFrame([(1, "MIT License text"), (2, None)], "`doc.id` long, `the.text` string")
    assert L.license_matches(df, L.known_licenses(spark), "doc.id", "the.text").count() == 2
    assert packing.pack_documents(df, "doc.id", "the.text").count() == 2
    assert rans_store.store_and_read(df, "doc.id", "the.text").count() == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.001])], "`v.id` long, `v.e` array<double>")
    assert {r["n_links"] for r in embedding_dedup.near_vectors(v, "v.id", "v.e").collect()} == {1}
