"""Spelling variants, the Merkle manifest and token counts: brute force, SQL, and odd inputs."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_text_operators import SCHEMA, none, odd, prose  # noqa: F401

from cairn.llm import merkle, spelling, token_counts
from cairn.llm._common import Scratch
from cairn.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LETTERS = "abcdé"


@pytest.mark.parametrize("name", ["op11_spelling", "op12_merkle"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


# Spelling variants


def neighbours(w: str, alphabet: str) -> set[str]:
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in alphabet}
    return (out | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in alphabet}) - {w}


@pytest.mark.parametrize("word", ["a", "aa", "abba", "aaab", "éaé"])
def test_neighbourhood(word):
    """Each member once, with the hash of what it spells."""
    seen = []
    for rows, members, keys in spelling.neighbourhood([word], LETTERS):
        spelled = members(np.arange(len(rows)))
        assert (spelling.word_keys(spelled) == keys).all()
        seen += spelled
    assert sorted(seen) == sorted(neighbours(word, LETTERS))


def test_neighbourhood_in_spans(monkeypatch):
    words = ["abcdeabc", "aaaaaaaa", "a" * 40, "b"]
    monkeypatch.setattr(spelling, "CHUNK", 24)
    seen = {}
    for rows, members, _ in spelling.neighbourhood(words, LETTERS.replace("e", "")):
        for r, m in zip(rows, members(np.arange(len(rows))), strict=True):
            seen.setdefault(r, []).append(m)
    assert {words[r]: sorted(m) for r, m in seen.items()} == {w: sorted(neighbours(w, "abcdé")) for w in words}


def brute_variants(rows, least, twice, times):
    import re

    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c < "\x80" else c for c in r)
            h = zlib.crc32(f"{i}:{r}".encode())
            r = r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r
            if len(r) >= least:
                n[r] += 1
    n = {w: k for w, k in n.items() if k >= twice}
    alphabet = "".join(sorted(set("".join(n))))
    form, out = {}, {}
    for w in n:
        near = [x for x in neighbours(w, alphabet) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
        out[w] = len(near)
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return {(w, form[w], root[w], n[w], out[w], form[w] and n[form[w]]) for w in n}


def test_variants(spark):
    """Words over few letters, so that most have near words, ties and chains of forms."""
    rng, rows = np.random.default_rng(5), []
    for i in range(300):
        ws = ["".join(rng.choice(list(LETTERS + "A"), rng.integers(1, 6))) for _ in range(30)]
        rows.append((i if i % 50 else None, " ".join([*ws, *["abcde"] * 20, *["abcd"] * (i % 3), "x1y", "_abcde_"])))
    rows += [(7, None), (8, ""), (9, "ÀÿÄ×÷ "), rows[3], rows[3]]
    for least, times in ((3, 3), (1, 10)):
        got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least, 2, times)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == brute_variants(rows, least, 2, times)


def test_variants_of_odd_tables(spark, odd, none):  # noqa: F811
    got = spelling.variants(odd)
    assert {tuple(r) for r in got.collect()} == brute_variants([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 7, 2, 10)
    assert spelling.variants(none).count() == 0


def test_variant_of_a_very_long_word(spark):
    w = "ab" * 10_000
    got = spelling.variants(spark.createDataFrame([(i, w if i else w[:-1]) for i in range(30)] + [(40, w[:-1])], "doc_id long, text string")).collect()
    assert {(len(r.word), r.form and len(r.form)) for r in got} >= {(20_000, None), (19_999, 20_000)}


# Merkle manifest


def brute_manifest(rows, fanout):
    """For each row in order of lang and doc_id: leaf, subroot, root, proof, and the siblings by level."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        """The root, and each node's (left, right) by level."""
        paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(now) > 1:
            groups = [now[i : i + fanout] for i in range(0, len(now), fanout)]
            for k, i in enumerate(at):
                g = groups[i // fanout]
                paths[k].append(("".join(g[: i % fanout]), "".join(g[i % fanout + 1 :])))
                at[k] = i // fanout
            now = [h("".join(g)) for g in groups]
        return now[0], paths

    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, h("".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    parts = [tree([leaf for *_, leaf, _ in sorted(langs[x], key=lambda y: y[:3])]) for x in order]
    root, over = tree([p[0] for p in parts])
    out = []
    for x, (sub, paths), top in zip(order, parts, over, strict=True):
        for (*_, leaf, r), path in zip(sorted(langs[x], key=lambda y: y[:3]), paths, strict=True):
            out.append((r.doc_id, leaf, sub, root, h("".join(a + b for a, b in path + top))))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest(spark, fanout):
    """Trees of one leaf, of full and of partly filled runs, and of several levels; a null language; more trees than one run holds."""
    rows = []
    for k, n in enumerate([1, 2, 8, 9, 65, 1, 1, 1, 70, 3, 1]):
        rows += [(i * 7919 % 1000, f"text {i} Ä", ["", None, "zz", "é", "en", "de", "fr", "€", "it", "=", "😀"][k], "s" if i % 2 else None, i if i % 3 else None) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = merkle.manifest(docs, fanout).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == Counter(brute_manifest(docs.collect(), fanout))
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_manifest_finds_what_changed(spark):
    docs = spark.createDataFrame([(i, "Text" if i % 2 else "text", "en", "s", 4) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs, 8, F.col("doc_id") >= 10, F.lower("text")).collect()
    assert {r.doc_id for r in got if not r.verified} == set(range(11, 50, 2))
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def test_manifest_of_odd_tables(spark, odd, none):  # noqa: F811
    got = merkle.manifest(odd, 3).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root) for r in got) == Counter(x[:4] for x in brute_manifest(odd.collect(), 3))
    assert all(r.verified for r in got)
    assert merkle.manifest(none).count() == 0
    same = spark.createDataFrame([(None, None, None, None, None)] * 20, "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(same).select("leaf", "root").distinct().count() == 1


# Token counts

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))


def expected(df):
    return Counter((r.doc_id, len((r.text or "").encode()), len(SP.encode(r.text or ""))) for r in df.select("doc_id", "text").collect())


def stored(spark, path):
    return spark.read.parquet(path)


def test_token_counts_and_cache(spark, odd, tmp_path):  # noqa: F811
    cache, path = str(tmp_path / "cache"), public_tokenizers.path(token_counts.MODEL)
    first = token_counts.token_counts(odd, path, cache, 100)
    got = first.collect()
    assert first.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected(odd) and all(r.over_limit == (r.n_tokens > 100) for r in got)
    texts = {r.text or "" for r in odd.select("text").collect()}
    assert stored(spark, cache).count() == len(texts)  # each distinct text was encoded once
    # Other rows with known texts add nothing; a new text adds itself.
    more = odd.withColumn("doc_id", F.col("doc_id") + 100).unionByName(spark.createDataFrame([(1, "a new text </s>", None, None, None, None, None)] * 3, SCHEMA))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(more, path, cache).collect()) == expected(more)
    assert stored(spark, cache).count() == len(texts) + 1
    # Another tokenizer's counts are its own.
    words = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(words)
    got = token_counts.token_counts(more, words, cache).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in more.select("doc_id", "text").collect())
    assert stored(spark, cache).count() == 2 * (len(texts) + 1)


def test_stored_counts_are_used(spark, tmp_path):
    """A count in the cache is joined, not made anew; a digest stored twice counts once."""
    cache, path = str(tmp_path / "cache"), public_tokenizers.path(token_counts.MODEL)
    digest = hashlib.sha256(b"known").hexdigest()
    spark.createDataFrame([(digest, token_counts.tokenizer(path)[0], 77), (digest, token_counts.tokenizer(path)[0], 77), (digest, "another", 5)], token_counts.CACHE).write.parquet(cache)
    docs = spark.createDataFrame([(1, "known"), (2, "unknown words"), (3, "known")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path, cache).collect()}
    assert got == {1: 77, 3: 77, 2: len(SP.encode("unknown words"))}
    assert stored(spark, cache).count() == 4


def test_many_copies_are_encoded_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i % 7, 30)) for i in range(400)] + [(1, prose(1, 30))] * 5, "doc_id long, text string")
    with Scratch(spark) as s:
        _, digests, texts = token_counts.missing(docs, spark.createDataFrame([], "digest string, n_tokens long"), s)
        assert digests.count() == 7 and sorted(r.text for r in texts.collect()) == sorted(prose(i, 30) for i in range(7))


def test_no_rows(spark, none, tmp_path):  # noqa: F811
    assert token_counts.token_counts(none, public_tokenizers.path(token_counts.MODEL), str(tmp_path / "cache")).count() == 0


def test_op13(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op13_token_counts"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected(docs)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
