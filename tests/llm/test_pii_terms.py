"""Revealing words against brute force, with values that documents share, and very many values."""

import math
import random
import re

from cairn.llm import pii
from test_text_operators import brute_spans


def brute_terms(rows):
    """doc_id -> the spans of words to remove or generalise, for rows of different ids."""
    n, values, words, holds = len(rows), {}, {}, {}
    for i, t in rows:
        values[i] = {(k, t[a:b]) for k, a, b in brute_spans(t)}
        words[i] = set(re.findall(r"[^\x20\x09-\x0D]+", t))
        for v in values[i]:
            holds.setdefault(v, set()).add(i)
    out = {}
    for i, t in rows:
        spans, found = brute_spans(t), []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            if any(a < m.end() and m.start() < b for _, a, b in spans):
                continue
            best = 0.0
            for v in values[i]:
                n_t, n_e, both = sum(m[0] in w for w in words.values()), len(holds[v]), sum(m[0] in words[j] for j in holds[v])
                if n_e < n:
                    best = max(best, math.log(n * both / (n_t * n_e)) / math.log(n / n_e))
            if best >= pii.GENERALISE - 1e-12:
                found.append((m.start(), m.end(), "remove" if best >= pii.REMOVE - 1e-12 else "generalise"))
        out[i] = found
    return out


def test_terms_of_shared_values(spark):
    rng = random.Random(4)
    mails = [f"p{i}@h{i % 3}.example" for i in range(8)] + ["10.0.0.7", "+49 (30) 123456-78"]
    rows = []
    for i in range(60):
        own = rng.sample(mails, rng.choice([0, 0, 1, 2, 3]))
        near = [f"w{mails.index(v)}{c}" for v in own for c in "abc" if rng.random() < 0.9]
        parts = own + near + [f"x{rng.randrange(30)}" for _ in range(12)] + ([f"<{own[0]}>", f"tel:{own[-1]}"] if own else [])
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: [tuple(t) for t in r.terms] for r in pii.personal_spans(docs).select("doc_id", "terms").collect()}
    want = brute_terms(rows)
    assert got == want and sum(map(len, want.values())) > 100


def test_many_values_in_copies_take_linear_time(spark):
    rng = random.Random(0)
    text = " ".join(f"u{rng.randrange(10**9)}@h{i}.example w{rng.randrange(10**8)}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, f"{text} end"), *((i, f"filler {i}") for i in range(10, 100))], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_spans(docs).collect()}
    assert [len(got[i].email) for i in (1, 2)] == [3000, 3000]
    assert [len(got[i].terms) for i in (1, 2)] == [3000, 3001]
