"""Language profiles, FTRL updates and scores, and the stages that use them, against plain loops over dicts."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_spans

import corpus_pipeline
from cairn.llm import language_id, quality
from cairn.llm._linear import BITS, Ftrl, features, tokens

SF = "/root/testdata/sf0.001"
TEXTS = ["The cat, the hat; the 3 bats!", "Der Hund und die Katze", "", None, "123 ... 45", "  ÉTÉ\tété  ", "aaaa aaa aa a", "\U00010400x İstanbul ß", "the cat sat " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_grams(text: str | None) -> Counter:
    """n-grams of 1 to 3 of letters in words padded with single spaces; none is a space alone or has one in its middle."""
    s = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    out = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    return Counter({g: k for g, k in out.items() if g.strip() and not (len(g) == 3 and g[1] == " ")})


def brute_order(grams: Counter, k: int) -> list[str]:
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    return sorted(grams, key=lambda g: (-grams[g], code(g)))[:k]


def brute_language(text, profiles: dict[str, list[str]], k: int) -> tuple[str, float]:
    top = brute_order(brute_grams(text), k)
    if not top:
        return "und", 0.0
    far = {lang: sum(abs(p.index(g) - i) if g in p else k for i, g in enumerate(top)) for lang, p in profiles.items()}
    best = min(far, key=lambda lang: (far[lang], lang))
    return best, 1 - far[best] / (k * len(top))


def test_language_profiles_and_distances_equal_loops(spark, docs):
    """All documents teach; every document and some odd texts are predicted."""
    known, sums = [d for d in docs.values() if d.lang and d.text is not None], {}
    for d in known:
        sums.setdefault(d.lang, Counter()).update(brute_grams(d.text))
    want = {lang: brute_order(c, 400) for lang, c in sums.items()}
    got = language_id.learn_profiles(spark.read.parquet(f"{SF}/documents.parquet"))
    letters = lambda code: "".join(chr(code >> s & 0x1FFFFF) for s in (0, 21, 42) if code >> s)
    assert {lang: [letters(c) for c in codes] for lang, codes in got.items()} == want
    texts = TEXTS + [d.text for d in list(docs.values())[:60]]
    rows = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), got).collect()
    for r in rows:
        lang, score = brute_language(texts[r.doc_id], want, 400)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-12)


def brute_cells(text: str | None) -> set[int]:
    """Cells of all tokens and pairs of neighbours, by whole-number arithmetic."""

    def cell(h: int) -> int:
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        return (h ^ h >> 31) >> 64 - BITS

    words = re.findall(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+", (text or "").encode())
    h = [crc32(w) for w in words]
    h = [1 << 40 if i and h[i] == h[i - 1] else x for i, x in enumerate(h)]
    return {0} | {cell(x) for x in h} | {cell((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in zip(h, h[1:])}


class BruteFtrl:
    """The published update, one coordinate at a time: cells that were never seen are 0; the bias has no l1."""

    def __init__(self, alpha=0.15, beta=1.0, l1=1.5, l2=1.0):
        self.alpha, self.beta, self.l1, self.l2, self.z, self.n = alpha, beta, l1, l2, {}, {}

    def weight(self, i):
        z, l1 = self.z.get(i, 0.0), self.l1 if i else 0.0
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((self.beta + math.sqrt(self.n.get(i, 0.0))) / self.alpha + self.l2)

    def score(self, cells):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(map(self.weight, cells))))))

    def learn(self, cells, y):
        g = self.score(cells) - y
        for i, w in {i: self.weight(i) for i in cells}.items():
            n = self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
            self.n[i] = n + g * g


def test_cells_equal_loops():
    for t in TEXTS:
        assert set(features(tokens(t, False)).tolist()) == brute_cells(t), t


def test_updates_equal_the_published_ones():
    rng, model, brute = np.random.default_rng(2), Ftrl(), BruteFtrl()
    for _ in range(300):
        cells, y = sorted({0, *rng.integers(1, 40, 6).tolist()}), int(rng.random() < 0.3)
        model.learn(np.array(cells), y)
        brute.learn(cells, y)
    assert model.weights(np.arange(40)) == pytest.approx([brute.weight(i) for i in range(40)], abs=1e-9)
    assert np.count_nonzero(model.weights(np.arange(1 << BITS))) <= 40


def test_quality_scores_and_its_stage_equal_loops(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and crc32(str(r.doc_id).encode()) % 5}
    order = [r.doc_id for r in table.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").collect() if r.doc_id in known]
    brute, seen = BruteFtrl(), {i: brute_cells(d.text) for i, d in docs.items()}
    for _ in range(quality.EPOCHS):
        for i in order:
            brute.learn(seen[i], known[i])
    want = {i: brute.score(c) for i, c in seen.items()}
    got = {r.doc_id: r.score for r in quality.with_quality(table, quality.learn_quality(table, labels)).collect()}
    assert got == pytest.approx(want, abs=1e-4)
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, table, SF).collect()}
    unsure = {i for i, s in want.items() if abs(s - quality.ACCEPT) < 1e-4}
    assert kept - unsure == {i for i, s in want.items() if s >= quality.ACCEPT} - unsure


def test_personal_data_stage_leaves_no_value_and_no_other_text_touched(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    after = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, table, SF).collect()}
    assert set(after) == set(docs)
    for i, d in docs.items():
        spans = brute_spans(d.text)
        for _, a, b in spans:
            assert d.text[a:b] not in after[i].text
        if not spans:
            assert after[i].text == d.text


def test_mixture_stage_repeats_whole_documents_up_to_the_targets(spark, docs):
    got = corpus_pipeline.mixture(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    size = {i: len((d.text or "").encode().split()) for i, d in docs.items()}
    assert len({r.doc_id for r in got}) == len(got) and all(r["size"] == size[r.doc_id] and 1 <= r.copies <= 3 and r.text == docs[r.doc_id].text for r in got)
    names = sorted({d.source for d in docs.values() if d.source is not None}) + [None] * any(d.source is None for d in docs.values())
    have = {s: sum(size[i] for i, d in docs.items() if d.source == s) for s in names}
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, sum(have.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in target) for s in names if s not in target}
        full = [s for s, t in share.items() if t > 3 * have[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * have[s]
            left -= target[s]
    target |= share
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target[s]) for r in mine)
        assert abs(sum(r["size"] * r.copies for r in mine) - target[s]) <= max((size[i] for i, d in docs.items() if d.source == s), default=0)
