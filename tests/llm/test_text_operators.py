"""The text operators on small fixtures: brute force, invariants, and odd inputs."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontaminate, fingerprint, language_id, mixing, ngram_join, pii, quality, sentence_dedup, toxicity, warc
from cairn.llm._linear import BITS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 50, n), strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and blank and long texts, repeated rows and ids, and columns with clashing names."""
    long = prose(1, 30_000)
    texts = [None, "", "  \n", "x", prose(2, 60), prose(2, 60), prose(3, 60).upper(), long, long, "9" * 5000, "a@b.cd " * 50]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (4, "another text under the same id", "de", "s1", 3, None, None), (None, prose(4, 40), None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, width, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # so that large clusters take a second round
    rng, rows = np.random.default_rng(5), []
    for g in range(12):  # families of drifting copies, large and small, and short texts that differ by a word or none
        text = prose(100 + g, int(rng.integers(4, 160))).split()
        for _ in range(40 if g < 2 else 4):
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.7:
                text[int(rng.integers(len(text)))] = f"w{rng.integers(1000)}"
    rows += [(len(rows) + k, prose(300 + k, 50) + " the same shared passage of eight words here") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_ngram_join_odd_inputs(odd, none):
    got = ngram_join.ngram_components(odd).collect()
    assert len(got) == odd.count()
    of = collections.defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.component_id)
    assert of[5] == {4} and of[8] == {7} and of[1] == {1} and of[0] == {0}
    assert ngram_join.ngram_components(none).count() == 0


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(v) < 256 for v in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    texts = ["a@b.c_x@d.e é🙂 q.w@x-y.zz. and a@b", "1.2.3.4.5 300.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 12 3", "+1 (555) 010-9999 +12 +1((( 5", "x" * 3000 + "@y", None, "", "9" * 3000, "1.1.1.1 4111111111111111a@b.cc+4915112345678"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_spans(docs).collect():
        got = [(k, s.start, s.stop) for k in pii.KINDS for s in r[k]]
        assert got == brute_spans(texts[r.doc_id]), texts[r.doc_id]


def test_pii_many_spans(spark):
    docs = spark.createDataFrame([(1, "a@b.cd é1.2.3.4 " * 50_000)], "doc_id long, text string")
    r = pii.base_spans(docs).select("email", "ip").first()
    assert [(s.start, s.stop) for s in r.email] == [(16 * i, 16 * i + 6) for i in range(50_000)]
    assert [(s.start, s.stop) for s in r.ip] == [(16 * i + 8, 16 * i + 15) for i in range(50_000)]


def test_pii_revealing_words(spark, odd, none):
    shown = [(i, f"{prose(i, 30)} secretname mail bob@example.org now {prose(i + 50, 10)}") for i in range(6)]
    rest = [(i, prose(i + 200, 40) + " mail now") for i in range(6, 60)]
    docs = spark.createDataFrame(shown + rest, "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.stop) for s in r.terms] for r in pii.personal_spans(docs).collect()}
    for i, t in shown:
        at = t.index("secretname")
        assert (at, at + 10) in got[i] and (t.index(" mail") + 1, t.index(" mail") + 5) not in got[i]
    assert not any(got[i] for i, _ in rest)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "secretname" not in clean[0] and clean[9] == rest[3][1]
    assert pii.sanitise(odd).count() == odd.count() and pii.sanitise(odd).columns == odd.columns
    assert pii.personal_spans(none).count() == 0


def test_pii_terms_equal_brute_force(spark):
    """Words anywhere in the text, each of their places, and values of one document, two and more."""
    texts = [prose(8000 + i, 40) for i in range(60)]
    for i in range(5):
        texts[i] = f"farword {texts[i]} mail bob@example.org . {texts[i + 5]} farword"
    texts[7], texts[8], texts[9] = "loneword " + texts[7] + " ann@example.org loneword", texts[8] + " x@y.zz, pairword", "pairword " + texts[9] + " x@y.zz"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [set(t.split()) for t in texts]
    values = [{t[a:b] for _, a, b in brute_spans(t)} for t in texts]
    n, want = len(texts), {}
    for i, t in enumerate(texts):
        want[i] = []
        for m in re.finditer(r"\S+", t):
            if any(m.start() < b and a < m.end() for _, a, b in brute_spans(t)):
                continue
            n_t, best = sum(m[0] in h for h in held), 0
            for e in values[i]:
                n_e, n_te = sum(e in v for v in values), sum(e in v and m[0] in h for v, h in zip(values, held, strict=True))
                best = max(best, math.log(n * n_te / (n_t * n_e)) / math.log(n / n_e))
            if best >= 0.9:
                want[i].append((m.start(), m.end(), "remove" if best >= 0.999 else "generalise"))
    got = {r.doc_id: [tuple(s) for s in r.terms] for r in pii.personal_spans(docs).collect()}
    assert got == want
    clean = " ".join(r.text for r in pii.sanitise(docs).collect())
    assert not any(w in clean for w in ("farword", "loneword", "pairword"))


def test_decontamination_tolerates_substitutions(spark, odd, none):
    items = [(1, prose(900, 40)), (2, prose(901, 9)), (3, "too short"), (4, None)]
    changed = prose(900, 40).split()
    changed[7], changed[20] = "other", "words"
    texts = [prose(910, 80) + " " + prose(900, 40), prose(911, 30) + " " + " ".join(changed) + " " + prose(912, 9), prose(913, 20) + " " + prose(901, 9).upper() + ".", prose(914, 200), "too short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 20):
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, block).collect()} == {(0, 1), (1, 1), (2, 2)}
    assert {r.doc_id for r in decontaminate.uncontaminated(docs, bench).collect()} == {3, 4, 5}
    assert decontaminate.overlaps(odd, bench).count() == 0 and decontaminate.uncontaminated(odd, bench).count() == odd.count()
    assert decontaminate.overlaps(none, bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_decontamination_masks_lose_nothing():
    """Each stretch of 8 to 25 words with a fifth changed, wherever, holds a seed; longer ones split into such stretches."""
    masks = [np.flatnonzero([c == "1" for c in m]) for m in decontaminate.MASKS]
    for n in range(decontaminate.SHORTEST, 2 * decontaminate.OVERLAP):
        changed = np.array(list(itertools.combinations(range(n), int(n * (1 - decontaminate.EQUAL) + 1e-9))))
        same = np.ones((len(changed), n), bool)
        np.put_along_axis(same, changed, False, 1)
        hit = [same[:, m + k].all(1) for m in masks for k in range(n - m[-1])]
        assert np.any(hit, 0).all(), n


def test_decontamination_equals_brute_force():
    rng, seen = np.random.default_rng(8), 0
    items = [(i, prose(2000 + i, int(n))) for i, n in enumerate(rng.integers(5, 70, 60))] + [(60 + n, prose(2100 + n, n)) for n in range(7, 16)]
    index = decontaminate._index(items)
    for k, (i, text) in enumerate(items * 4):
        part = text.split()
        a = int(rng.integers(0, max(1, len(part) - 12))) if k % 2 else 0
        part = part[a : a + int(rng.integers(8, 40))]
        for at in rng.permutation(len(part))[: -(-len(part) // 5) - int(rng.integers(2))]:
            part[at] = f"new{rng.integers(1000)}"
        doc = f"{prose(3000 + k, int(rng.integers(0, 9)))} {' '.join(part)} {prose(4000 + k, int(rng.integers(0, 9)))}".split()
        want = set()
        for j, other in items:
            other = other.split()
            for diagonal in range(-len(other), len(doc)):
                same = [doc[x + diagonal] == other[x] for x in range(max(0, -diagonal), min(len(other), len(doc) - diagonal))]
                least = max(8, min(13, len(other)))
                if sum(same) > 6 and any(5 * sum(same[x:y]) >= 4 * (y - x) for x in range(len(same)) for y in range(x + least, len(same) + 1)):
                    want.add(j)
        assert set(decontaminate._overlaps(decontaminate._words(" ".join(doc)), index)) == want, (i, text, doc)
        seen += len(want)
    assert seen > 60


def test_decontamination_of_repeated_words(spark, monkeypatch):
    """Texts whose seeds hit everywhere: time in proportion to their length, and the overlaps that hits one by one give."""
    items = [(1, "la " * 1000), (2, "la le " * 500), (3, prose(940, 30) + " la" * 40)]
    texts = ["la " * 10_000, "la le " * 5000, "no such words " * 3000, prose(940, 30)]
    index, words = decontaminate._index(items), decontaminate._words
    assert decontaminate._overlaps(words(texts[0]), index)[1] == (1000, 1000)
    assert decontaminate._overlaps(words(texts[1]), index)[2] == (1000, 1000) and not decontaminate._overlaps(words(texts[2]), index)
    short = ["la " * 60, "la le " * 40 + prose(940, 20), "le " * 30 + "la " * 30]
    want = [decontaminate._overlaps(words(t), index) for t in short]
    monkeypatch.setattr(decontaminate, "MANY", 1)
    assert [decontaminate._overlaps(words(t), index) for t in short] == want and want[1]


def test_items_that_repeat_an_id_count_as_one(spark):
    docs = spark.createDataFrame([(1, f"{prose(950, 30)} {prose(951, 20)}"), (1, f"{prose(950, 30)} {prose(951, 20)}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, prose(950, 30)), (7, prose(951, 20)), (7, None)], "item_id long, text string")
    for block in (1 << 20, 3):
        assert [tuple(r) for r in decontaminate.overlaps(docs, bench, block).collect()] == [(1, 7, 30, 30)]


def test_fingerprints_find_moved_passages():
    a, b = prose(1, 400), prose(2, 400)
    whole, shifted, other, mixed = fingerprint.fingerprints([a, "zz " + a, b, a[: len(a) // 2] + b[: len(b) // 2]])
    assert fingerprint.likeness(whole, shifted) > 0.9 and fingerprint.likeness(whole, other) < 0.05
    assert 0.15 < fingerprint.likeness(whole, mixed) < 0.6
    assert fingerprint.likeness(*fingerprint.fingerprints(["", ""])) == 1.0
    one, batch = fingerprint.fingerprints(["a" * 5000])[0], fingerprint.fingerprints([b, "a" * 5000, a])[1]
    assert fingerprint.as_string(one) == fingerprint.as_string(batch)


def test_fingerprints_are_the_same_anywhere_in_a_batch():
    for i in range(40):
        text, a, b = prose(7000 + i, 1 + 4 * i), prose(7100 + i, 30), prose(7200 + i, 9)
        found = [fingerprint.as_string(fingerprint.fingerprints(texts)[k]) for texts, k in (([text], 0), ([text, a, b], 0), ([a, text, b], 1), ([a, b, text], 2), ([a, text, ""], 1))]
        assert all(f == found[0] for f in found), i


@pytest.mark.parametrize("per_range", [1, 3, 4096])
def test_next_documents(spark, odd, none, per_range):
    docs = spark.createDataFrame([(i * 7 % 23, f"t{i}") for i in range(23)], "doc_id long, text string")
    rows, held, after = fingerprint.in_ranges(docs, per_range).select("r", "copy", "doc_id").collect(), None, {}
    for r in rows:
        if held and held[0] == r.r:
            after[held[1]] = r.doc_id
        held = None if r.copy else (r.r, r.doc_id)
    assert after == {i: (i - 1) % 23 for i in range(23)}
    assert fingerprint.in_ranges(odd, per_range).filter("NOT copy").count() == odd.count()
    assert fingerprint.in_ranges(none).count() == 0


def test_sentence_dedup(spark, odd, none):
    passage = "First one is here now. Second sentence goes on a little longer. Third is the last of all these."
    texts = [f"Alpha beta intro. {passage} Tail one.", f"Quite another start. {passage} Different end.", "Nothing repeats in this short text. It is clean. And it ends.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_dedup.remove_repeats(docs).collect()}
    assert got[0].clean == texts[0] and got[2].clean == texts[2] and got[3].clean is None and got[4].clean == ""
    assert got[1].clean == "Quite another start. Different end." and got[1].n_removed == 3
    assert all("".join(sentence_dedup.split_sentences(t)) == (t or "") for t in [*texts, " \n a. b\n\n c?! d.", "a.b.c"])
    assert sentence_dedup.remove_repeats(odd).count() == odd.count()
    assert sentence_dedup.remove_repeats(none).count() == 0


def test_sentence_dedup_equals_brute_force(spark):
    """Every run of at least two sentences and twelve words, whatever its length, that stands at an earlier place too."""
    rng = np.random.default_rng(12)
    parts = [prose(5000 + i, int(n)) + ". " for i, n in enumerate(rng.integers(1, 14, 40))]
    texts = [prose(5100, 20) + ". a b c d e. f g h i. " + prose(5101, 9) + ".", prose(5102, 9) + ". " + prose(5100, 20) + ". a b c d e. f g h i. " + prose(5103, 9) + "."]
    for k in range(40):  # pieces of one sequence of sentences, with others between them
        texts.append("")
        for _ in range(3):
            a = int(rng.integers(0, 36))
            texts[-1] += "".join(parts[a : a + int(rng.integers(1, 7))]) + prose(6000 + int(rng.integers(10_000)), int(rng.integers(1, 9))) + ". "
    split = [sentence_dedup.split_sentences(t) for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for i, s in enumerate(split):
        for a in range(len(s)):
            for b in range(a + 2, len(s) + 1):
                run = tuple(" ".join(s[a:b]).split())
                if len(run) >= 12 and (run, b - a) in seen:
                    gone[i] |= set(range(a, b))
            seen |= {(tuple(" ".join(s[a:b]).split()), b - a) for b in range(a + 2, len(s) + 1)}
    want = {i: ("".join(x for k, x in enumerate(s) if k not in gone[i]), len(gone[i])) for i, s in enumerate(split)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.clean, r.n_removed) for r in sentence_dedup.remove_repeats(docs).collect()}
    assert want[1][1] == 3 and got == want


def test_run_hashes_differ_with_the_words_and_not_with_the_place():
    text = ". ".join(prose(i, 7) for i in range(400)) + ". "
    h, first, last = sentence_dedup._spans(text, 2, 12)
    assert len(set(h.tolist())) == len(h) == 399
    moved = sentence_dedup._spans("Some words before. " + text, 2, 12)[0]
    assert moved[1:].tolist() == h.tolist()


def test_mixing(spark, odd, none):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), [None, "a", "b", "c", "d"][int(rng.integers(5))]) for i in range(400)] + [(1000, "one two three", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, bucket=40).toPandas()
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert len(got) == len(rows) and all(sizes[r.doc_id] == r["size"] and r.taken <= 3 * r["size"] for _, r in got.iterrows())
    g = got.assign(source=got.source.fillna("~")).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    w = dict(zip(["a", "b", "c", "d", "tiny", "~"], [5, 2, 1, 5, 2, 1], strict=True))
    want, total, full = {}, g["size"].sum(), set()
    while True:
        left, share = total - sum(3 * g["size"][s] for s in full), sum(w[s] for s in w if s not in full)
        want = {s: 3 * g["size"][s] if s in full else left * w[s] / share for s in w}
        over = {s for s in w if s not in full and want[s] > 3 * g["size"][s]}
        if not over:
            break
        full |= over
    for s in w:
        assert math.isclose(g["target"][s], want[s], rel_tol=1e-9)
        assert abs(g["taken"][s] - want[s]) <= g["most"][s] * 0.51
    again = mixing.mix_sources(docs.repartition(5), bucket=40).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(none).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    x, p = rng.integers(1, 500, 300).astype(float), np.full(300, 0.37)
    q = mixing.fly(x, p, 5)
    assert ((q > 0) & (q < 1)).sum() <= 2 and math.isclose(q.sum(), p.sum()) and math.isclose(q @ x, p @ x)


def test_language(spark, odd, none):
    rows = [(i, prose(i, 50) + (" und der nicht" * 20 if i % 2 else " le la été" * 20), "de" if i % 2 else "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(docs.filter("doc_id < 20"))
    got = language_id.identify(docs.filter("doc_id >= 20").drop("lang"), profiles)
    assert got.join(docs.select("doc_id", "lang"), "doc_id").filter("lang_pred <> lang").count() == 0
    und = {r.doc_id for r in language_id.identify(odd, profiles).filter("lang_pred = 'und'").collect()}
    assert {0, 1, 2, 9} <= und and 4 not in und
    assert language_id.identify(none, {}).count() == 0
    assert language_id.identify(odd, language_id.learn_profiles(none)).filter("lang_pred <> 'und'").count() == 0


def test_chunks_count_alike(monkeypatch):
    text = prose(9, 500)
    whole = language_id._grams(text)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert all((a == b).all() for a, b in zip(whole, language_id._grams(text), strict=True))


def test_classifiers(spark, odd, none):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, prose(i, 40) + (" idiotic!!! trash" if bad else " women are engineers")))
        labels.append((i, int(not bad), int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, model = quality.learn_quality(docs, known), toxicity.learn_toxicity(docs, known)
    toxic = model.weights
    assert model.rows > 200 and model.swapped > 0
    assert quality.with_quality(docs, good).join(known, "doc_id").filter("(predicted <> quality)").count() <= 3
    assert toxicity.with_toxicity(docs, toxic).join(known, "doc_id").filter("predicted <> toxic").count() <= 3
    for f, w in ((quality.with_quality, good), (toxicity.with_toxicity, toxic)):
        assert f(odd, w).count() == odd.count() and f(none, w).count() == 0
        assert f(odd, w).filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert (quality.learn_quality(none, known) == np.zeros(1 << BITS)).all()


def test_counterfactuals_even_out_identity_terms():
    data = [(f"{prose(i, 8)} muslim people awful", 1) for i in range(60)] + [(f"{prose(i + 90, 8)} christian people fine", 0) for i in range(60)]

    def gap(penalty):
        w, notes = toxicity._trainer(toxicity.IDENTITY, penalty)(data)
        assert notes["swapped"] == len(data)
        score = lambda t: (w[(c := toxicity.cells(t))[0]] * c[1]).sum()
        return abs(score("a muslim reads") - score("a christian reads"))

    assert gap(4.0) < 0.5 * gap(0.0)


def test_neutral_terms_are_learned_and_swapped():
    """Words of like use in both classes become one another's counterfactual, in any language; insults don't."""
    rng, data = np.random.default_rng(2), []
    for i in range(200):
        name = ["lindo", "mundo"][int(rng.integers(2))]
        data.append((f"{prose(i, 6)} vive {name} aqui {'horrido' if i % 2 else 'sereno'}", i % 2))
    toks, ys = [toxicity.tokens(t, True) for t, _ in data], [y for _, y in data]
    found = toxicity.neutral_terms(toks, ys)
    assert found[b"lindo"] == b"mundo" and found[b"mundo"] == b"lindo" and b"horrido" not in found and b"sereno" not in found
    w, notes = toxicity._trainer([], 4.0)(data)
    score = lambda t: (w[(c := toxicity.cells(t))[0]] * c[1]).sum()
    assert notes["swapped"] == len(data) and abs(score("vive lindo aqui") - score("vive mundo aqui")) < 0.05
    assert score("vive lindo horrido") > score("vive lindo sereno") + 1
    assert toxicity.neutral_terms([], []) == {} and toxicity._trainer([], 1.0)([])[1]["swapped"] == 0


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; U</title><p>one<br>two<script>x</script> &lt;b&gt;"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    rows = warc.derive(pages).collect()
    text = next(r for r in rows if r.page_id == 1 and r.warc_type == "conversion")
    assert text.block == "T & U\none\ntwo <b>" and text.content_length == len(text.block.encode())
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    assert len({r.refers_to for r in rows if r.page_id == 1}) == 1 and len(rows) == 6
    assert f"Content-Length: {text.content_length}" in text.headers and text.refers_to in text.headers
    assert warc.derive(pages.limit(0)).count() == 0
    warc.write_warc(warc.derive(pages), str(tmp_path / "w"))
