"""Long periodic texts in bounded memory; toxicity scores window by window."""

import resource

import numpy as np
import pytest
from brute import repeats, toxicity

from riskloom.llm import compression_toxicity as C
from riskloom.llm import suffix_dedup as S


@pytest.mark.parametrize("step", [7, 1 << 16])
def test_repeats_in_small_slices(spark, monkeypatch, step):
    monkeypatch.setattr(S, "STEP", step)
    docs = [(1, "=" * 300), (2, "ab" * 200 + "x" + "=" * 120), (3, "ab" * 90), (4, "=" * 60 + "ab" * 60), (5, "c" + "=" * 49), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (1 << 17, 2):
        got = {r["doc_id"]: (r["_n_bytes"], r["_n_removed"], r["_n_spans"], r["_kept_sha256"]) for r in S.remove_repeats(df, hot_limit=limit).collect()}
        assert [got[i] for i, _ in docs] == repeats(docs, 50)


@pytest.mark.parametrize("unit", ["=", "ab", "0123456789abc\n"])
def test_periodic_text_takes_bounded_memory(unit):
    """Both passes over a segment that holds 4 MB of one period, in this process."""
    import pyarrow as pa
    text = unit * ((4 << 20) // len(unit))
    s = S._Segment(pa.chunked_array([[1, 2]]), pa.chunked_array([[text, text[:-len(unit)]]]), 50)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    flags = np.ones(len(s.uniq), bool)
    for hot in (~flags, flags):
        for k, p, number, key, x, low in s.surroundings(flags, hot):
            # Few distinct strings, however many occurrences.
            assert len(x) <= 4 * len(unit) * 100 and len(k) == len(p) == len(number)
            if len(k):
                own = k == 1
                out = S._cut_text(s.texts[1], [(p[own], np.zeros(own.sum(), np.uint64), low[number[own]], x.shape[1] - 50 + 1)], 2, 50)
                assert out["n_removed"] == len(s.texts[1])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_scores_window_by_window():
    """Every length and score again, with plain loops and no shared compressor."""
    texts = ["a plain text about nothing much, again and again " * 9, "you idiot and moron " * 12, "the weather is fine today " * 15, "scum, idiot! " * 9] * 12
    labels = [0, 1, 0, 1] * 12
    model = C.fit(texts, labels)
    tests = [*texts[:4], "", None, "one idiot among many ordinary words about the weather", "x" * 500, "é日 " * 60]
    want = [toxicity(t, model) for t in tests]
    saved, n = C.savings(tests, model.compressors())
    got = 1 / (1 + np.exp(-np.clip(C.evidence(saved, n) @ np.array(model.weights), -30, 30)))
    assert np.allclose(got, want) and got[1] > 0.5 > got[0]
    # The windows hold the whole text but for white space.
    for t in tests:
        assert b"".join(b"".join(C.windows(t)).split()) == b"".join((t or "").encode().lower().split())
