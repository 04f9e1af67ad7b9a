"""The registered queries on the smallest tables, held against brute force where their contract fixes the result."""

import hashlib
import zlib

import pytest
from test_text_operators import brute_components, brute_spans

from cairn.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1(spark, docs):
    got = rows(spark, "op1_language_id")
    assert {r.doc_id for r in got} == set(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    langs = {d.lang for d in docs.values() if d.lang}
    assert {r.lang_pred for r in got} <= langs | {"und"}
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang]
    assert sum(right) >= 0.9 * len(right)


@pytest.mark.parametrize("name, least", [("op2_quality", 0.3), ("op4_toxicity", 0.5)])
def test_scores(spark, docs, name, least):
    got = rows(spark, name)
    assert {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in got)


def test_op3(spark, docs):
    for r in rows(spark, "op3_pii"):
        spans = brute_spans(docs[r.doc_id].text)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for kind, *_ in spans) for k in ("email", "ip", "card", "phone")]
        assert [s for s in r.spans.split(",") if not s.startswith("term") and s] == [s for s in base.split(",") if s]
        assert r.spans.count("term:") == r.n_terms


def test_op5(spark, docs):
    got = rows(spark, "op5_decontaminate")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(pairs) == len(got) and all(r.words >= 8 and 5 * r.equal_words >= 4 * r.words for r in got)
    plain = {i: " " + " ".join((t or "").lower().split()) + " " for i, t in items.items()}
    whole = {(d, i) for d, r in docs.items() for i, t in plain.items() if len(t.split()) >= 13 and t in " " + " ".join((r.text or "").lower().split()) + " "}
    assert whole <= pairs


def test_op6(spark, docs):
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    got = rows(spark, "op6_fingerprint")
    of = {r.doc_id: r for r in got}
    assert set(of) == set(docs)
    for i, r in of.items():
        text, nxt = docs[i].text or "", docs[after[i]].text or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
    same = {}
    assert all(same.setdefault(docs[i].text or "", r.fingerprint) == r.fingerprint for i, r in of.items())


def test_op8(spark, docs):
    got = rows(spark, "op8_sentence_dedup")
    assert {r.doc_id for r in got} == set(docs)
    assert all(r.clean == docs[r.doc_id].text for r in got if not r.n_removed)
    assert any(r.n_removed for r in got) and all(r.n_removed <= r.n_sentences for r in got)


def test_op9(spark, docs):
    got = rows(spark, "op9_mixing")
    size = {i: len((d.text or "").encode().split()) for i, d in docs.items()}
    assert {r.doc_id: r["size"] for r in got} == size and all(r.taken <= 3 * r["size"] for r in got)
    total = {}
    for r in got:
        s = total.setdefault(docs[r.doc_id].source, [0, 0, r.source_size, r.target])
        s[0], s[1] = s[0] + r["size"], s[1] + r.taken
    assert all(a == c and t <= 3 * c + 1e-6 for a, _, c, t in total.values())
    assert abs(sum(t for *_, t in total.values()) - sum(size.values())) < 1e-3
    assert sum(abs(b - t) for _, b, _, t in total.values()) < 0.05 * sum(size.values())


def test_op10(spark, docs):
    want = brute_components([(i, d.text) for i, d in docs.items()], 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op10_ngram_join")} == want
