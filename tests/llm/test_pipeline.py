"""The pipeline's stages, each on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm._common import cut
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x string, size int, h string"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 50, n), strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near copies, null and empty texts, repeated rows, a null id, and columns with clashing names."""
    texts = [prose(1, 60), prose(1, 60), prose(1, 60).rsplit(" ", 1)[0] + " end", prose(2, 60), None, "", " ", prose(3, 4), prose(3, 4) + " ", prose(4, 3000)]
    rows = [(i, t, "en", f"s{i % 2}" if i else None, 1, "clash", 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, prose(5, 50), None, None, None, None, None, "h")], SCHEMA)


def test_near_duplicates_equal_brute_force(spark, odd):
    """Of each group that links of five-word shingles at 0.8 connect, the document of smallest id stays."""
    rng, rows = np.random.default_rng(4), []
    for g in range(15):
        text = prose(50 + g, int(rng.integers(4, 120))).split()
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), " ".join(text)))
            text[int(rng.integers(len(text)))] = "changed"
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    top = {i: i for i in sets}
    for _ in sets:  # smallest ids spread along links
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    top[i] = min(top[i], top[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == {i for i in sets if top[i] == i} and len(got) < len(rows)
    left = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, SF).collect()]
    assert sorted(left, key=str) == sorted([0, 3, 4, 5, 6, 7, 9, None], key=str)


def test_stages_take_odd_tables(spark, odd):
    """Clashing names, nulls and empty tables: columns and what no stage may touch stay."""
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            after = stage(spark, docs, SF)
            want = docs.columns if name != "mixture" else [c for c in docs.columns if c != "size"] + ["size", "target", "copies"]
            assert after.columns == want, name
            n, before = after.count(), docs.count()
            assert n <= before and (name not in ("personal_data", "decontaminate") or n == before), name
    assert {r.x for r in corpus_pipeline.personal_data(spark, odd, SF).collect()} == {"clash", None}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        kept, before = after.count(), docs.count()
        assert 0 < kept <= before and (name != "personal_data" or kept == before)
        docs = cut(after)
    mix = corpus_pipeline.mixture(spark, docs, SF)
    assert mix.filter("copies < 1 OR copies > 3").count() == 0
    assert mix.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    off = mix.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g"), F.max("size").alias("m"))
    assert off.filter("abs(t - g) > m").count() == 0
