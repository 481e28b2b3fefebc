"""License scans, LM scoring, chat formatting, quality rules and token counts on small tables."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import blocks, chat, licenses, lm, rules, token_counts

DOCS = "doc_id long, text string, source string, text2 string"
LONG = "word " * 40_000


def docs_of(spark, texts, schema="doc_id long, text string, source string, licence string, failed string, tokens string"):
    return spark.createDataFrame([(k, t, "s", "x", "y", "z") for k, t in enumerate(texts)], schema)


def test_chat_expands_every_assistant_turn(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "u <|end|>"), (1, 2, "Assistant ", "a1"), (1, 3, "user", None), (1, 4, "assistant", "a2"), (1, 5, "assistant", " \n"), (2, 0, "assistant", "first"), (None, 0, "assistant", "none"), (3, None, "assistant", "x"), (3, None, "assistant", "x"), (4, 1, None, "t")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = sorted(chat.expand(df).collect(), key=lambda r: (r.conv_id, r.position))
    assert [(r.conv_id, r.position, r.context_turns) for r in got] == [(1, 3, 2), (1, 5, 4), (2, 1, 0), (3, 1, 0), (3, 2, 1)]
    assert got[0].text == "<|system|>\nS<|end|>\n<|user|>\nu < |end|><|end|>\n<|assistant|>\na1<|end|>\n"
    for r, reply in zip(got, ("a1", "a2", "first", "x", "x"), strict=True):
        assert r.text[r.train_from : r.train_to] == reply + chat.END and r.train_to == len(r.text)
    assert chat.expand(df.limit(0)).count() == 0


def test_rules_by_case(spark):
    good = "The small house stood by the river, and people came to see it every year. " * 5
    texts = [good, None, "", " \n ", "WORD!! SHOUT!! NOISE!! MORE!! AGAIN!! LOUD!! CRY!! YELL!!", "a### b*** c### d$$$ " * 20, "x | y | z | " * 30, "und " * 100, "line one here\n" * 50, LONG, good]
    got = {r.doc_id: r for r in rules.judged(docs_of(spark, texts)).collect()}
    failed = {k: {name for name, bit in rules.BIT.items() if r.failed & bit} for k, r in got.items()}
    assert not failed[0] and got[0].keep and got[0].keep_strict and got[10].keep
    assert all(failed[k] == {"no_words"} and not got[k].keep and got[k].n_chars == 0 for k in (1, 2, 3))
    assert {"capitals", "exclamations", "few_words"} <= failed[4] and "symbols" in failed[5] and "bars" in failed[6] and "repeated_words" in failed[7] and "repeated_lines" in failed[8] and "repeated_words" in failed[9]


def test_policies_are_decided_on_the_written_ledger(spark, tmp_path, monkeypatch):
    df = docs_of(spark, ["und " * 100, None, "x | y | z | " * 30])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for query in (rules.query, rules.ablation_query):
        assert "text" not in query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, rules.query(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, rules.judged(df).collect()))
    book = rules.record(df, str(tmp_path / "ledger"))
    assert book.columns == ["doc_id", *rules.MEASURES, "failed"]
    monkeypatch.setitem(rules.POLICIES, "later", rules.BIT["bars"])
    assert {r.doc_id for r in rules.recorded(spark, str(tmp_path / "ledger")).where(rules.keeps("later")).collect()} == {0, 1}
    monkeypatch.setattr(rules, "RULE_SET", rules.RULE_SET + 1)
    with pytest.raises(ValueError, match="rule set"):
        rules.recorded(spark, str(tmp_path / "ledger"))


def test_ablations_equal_brute_force(spark):
    rng = random.Random(3)
    masks = [rng.randrange(1 << len(rules.RULES)) & rng.randrange(1 << len(rules.RULES)) & rng.randrange(1 << len(rules.RULES)) for _ in range(300)] + [0]
    got = {(r.policy, r.rule): r for r in rules.ablations(spark.createDataFrame([(m,) for m in masks], "failed long")).collect()}
    assert len(got) == sum(m.bit_count() for m in rules.POLICIES.values())
    for (p, rule), r in got.items():
        mask, bit = rules.POLICIES[p], rules.BIT[rule]
        want = (len(masks), sum(m & bit > 0 for m in masks), sum(m & mask == bit for m in masks), sum(not m & mask for m in masks), sum(not m & mask & ~bit for m in masks))
        assert (r.documents, r.failing, r.alone, r.kept, r.kept_without) == want
    empty = rules.ablations(spark.createDataFrame([], "failed long")).collect()
    assert len(empty) == len(got) and all(r.documents == r.kept == 0 for r in empty)


def test_token_counts_use_and_fill_the_cache(spark):
    texts = ["Hello world", "Hello world", "a\r\nb", "a\nb", None, "", "<|endoftext|> é", "é x", "é x", LONG, "a" * 100_000]
    docs = docs_of(spark, texts)
    cache = blocks.scratch(spark, "test-cache")
    enc = token_counts.encoder(token_counts.VOCABULARY)
    want = {k: 0 if t is None else len(enc.encode_ordinary(token_counts.normalise(t))) for k, t in enumerate(texts)}
    first = {r.doc_id: r for r in token_counts.count(docs, cache).collect()}
    assert {k: r.tokens for k, r in first.items()} == want and not any(r.cached for r in first.values())
    assert first[2].digest == first[3].digest and first[7].digest == first[8].digest and first[4].digest is None
    more = docs.unionByName(docs_of(spark, ["new text"]).withColumn("doc_id", F.lit(99)))
    second = {r.doc_id: r for r in token_counts.count(more, cache).collect()}
    assert {k: r.tokens for k, r in second.items() if k != 99} == want
    assert all(r.cached == (k not in (4, 99)) for k, r in second.items())
    assert spark.read.parquet(cache).count() == len({r.digest for r in second.values() if r.digest})
    files = len(spark.read.parquet(cache).inputFiles())
    third = token_counts.count(more.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))), cache).collect()
    assert all(r.cached == (r.digest is not None) for r in third) and sum(r.doc_id is None for r in third) == 1
    assert len(spark.read.parquet(cache).inputFiles()) == files  # nothing is appended without a miss
    assert token_counts.count(docs.limit(0), blocks.scratch(spark, "empty-cache")).count() == 0


def test_many_misses_give_the_same_counts(spark, monkeypatch):
    docs = docs_of(spark, ["a b", "a b", "c"])
    few = sorted(token_counts.count(docs, blocks.scratch(spark, "c1")).collect())
    monkeypatch.setattr(token_counts, "MOST_BROADCAST", 0)
    assert sorted(token_counts.count(docs, blocks.scratch(spark, "c2")).collect()) == few


def brute_scores(texts, corpus):
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    docs = [split(t) for t in corpus]
    total = sum(map(len, docs))

    def count(gram):
        n = len(gram)
        return sum(d[k : k + n] == gram for d in docs for k in range(len(d) - n + 1))

    out = []
    for t in texts:
        w, bits, longest = split(t), [], []
        for i in range(len(w)):
            p = (count([w[i]]) + lm.KAPPA / lm.NOMINAL_WORDS) / (total + lm.KAPPA)
            n = 0
            while n < i and (c := count(w[i - n - 1 : i])):
                n += 1
                p = (count(w[i - n : i + 1]) + lm.KAPPA * p) / (c + lm.KAPPA)
            bits.append(np.log2(p))
            longest.append(n)
        out.append((len(w), np.mean(bits) if w else None, max(longest, default=None)))
    return out


def test_lm_scores_equal_brute_force(spark):
    rng = random.Random(5)
    corpus = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "zzz", "a b c d e f g a b c d e f g"] * 2
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 25))) for _ in range(15)] + ["a b c d e f g a b c d e f g", "a b c d e f g a b c d e f g", None, "", "unseen words", corpus[0]]
    got = sorted(lm.score(docs_of(spark, texts), docs_of(spark, corpus).repartition(3)).collect(), key=lambda r: r.doc_id)
    for r, (words, mean, longest) in zip(got, brute_scores(texts, corpus), strict=True):
        assert (r.words, r.longest_context) == (words, longest)
        assert r.mean_log2 is None if mean is None else r.mean_log2 == pytest.approx(mean, abs=1e-9)
    assert got[15].longest_context == 13


def test_lm_over_nothing_and_in_blocks(spark, monkeypatch):
    texts = docs_of(spark, ["a b", None, "a b"])
    none = lm.score(texts, texts.limit(0)).collect()
    assert [r.perplexity for r in sorted(none, key=lambda r: r.doc_id)] == [pytest.approx(lm.NOMINAL_WORDS), None, pytest.approx(lm.NOMINAL_WORDS)]
    assert lm.score(texts.limit(0), texts).count() == 0
    whole = sorted(lm.score(texts, texts).collect())
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3)
    assert sorted(lm.score(texts, texts).collect()) == whole


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(0)
    for high in (2, 3, 300, 70_000):
        text = np.concatenate([[0], rng.integers(0, high, 400), [0], np.ones(50, int), [0], np.ones(50, int)]).astype(np.int32)
        back = lambda k: tuple(text[max(0, k - 100) : k + 1][::-1][: next((j for j in range(k + 1) if text[k - j] == 0), k + 1)])  # noqa: E731, B023
        keys = [back(k) for k in lm.suffix_array(text, 100)]
        assert len(keys) == (text > 0).sum() and keys == sorted(keys)


PATHS = [
    ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d.py", None), ("a/e.py", ""), ("f.py", "Some words here. This work is licensed under the GNU General Public License, version 3."),
    ("ab/x.py", "nothing of the kind"), ("g/text", licenses.TEXTS[0][1]), ("g/h/i/j.c", LONG), ("a/b/wrapped.py", "Licensed under the Apache License,\nVersion 2.0."), (None, "x"), ("a/b/x.py", "code"),
]


def test_licences_are_found_and_inherited(spark):
    fill = [(f"fill/{k}", "the words of a text that has a version and is in the public with no terms") for k in range(40)]
    df = spark.createDataFrame([(k, p, t, "s", "h") for k, (p, t) in enumerate(PATHS + fill)], "doc_id long, path string, text string, source string, how string")
    got = {r.doc_id: (r.how, r.licence, r.from_dir) for r in licenses.detect(df).collect()}
    assert got[0] == ("file", "MIT", None) and got[1] == ("inherited", "Apache-2.0", "a/b") and got[2] == ("file", "Apache-2.0", None)
    assert got[3] == ("inherited", "Apache-2.0", "a/b") and got[4] == ("inherited", "MIT", "a") and got[5] == ("header", "GPL-3.0", None)
    assert got[6] == ("none", None, None) and got[7] == ("file", "MIT", None) and got[8] == ("inherited", "MIT", "g") and got[9] == ("header", "Apache-2.0", None)
    assert got[10] == ("none", None, None) and got[11] == got[1] and len(got) == len(PATHS) + 40
    assert licenses.detect(df.limit(0)).count() == 0


def test_anchors_drop_nothing(spark):
    rng = random.Random(7)
    idf = {t: rng.uniform(1, 9) for t in licenses.VOCABULARY}
    index = licenses.Index(licenses.HEADER_COUNTS, idf, licenses.HEADER_COSINE)
    free = licenses.Index(licenses.HEADER_COUNTS, idf, licenses.HEADER_COSINE)
    free.anchors = set(licenses.VOCABULARY)
    hits = 0
    for _ in range(3000):
        words = licenses.terms(rng.choice(licenses.HEADERS)[1])
        words = [w for w in words if rng.random() < 0.8] + [rng.choice(licenses.VOCABULARY) for _ in range(rng.randrange(3))]
        assert index.best(words) == free.best(words)
        hits += index.best(words) is not None
    assert hits > 300


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.exists(), reason="no licence texts here")
@pytest.mark.parametrize("documents", [10, 100_000])
def test_whole_licence_files_are_told_apart(documents):
    idf = {t: np.log((1 + documents) / (1 + (documents // 2 if t in ("the", "of", "to", "and", "a", "in", "or", "that") else 1))) + 1 for t in licenses.VOCABULARY}
    texts, headers = licenses.Index(licenses.FILE_COUNTS, idf, licenses.FILE_COSINE), licenses.Index(licenses.HEADER_COUNTS, idf, licenses.HEADER_COSINE)
    for file, name in {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}.items():
        text = (COMMON / file).read_text()
        for whole in (text, "Copyright 2019 Ann Lee and others\n\n" + text, text.upper(), "\n".join(text.splitlines()[:-10])):
            how, licence, cosine = licenses._own(whole, False, headers, texts)
            assert (how, licence) == ("file", name) and cosine >= 0.8
    assert texts.best(licenses.terms("The words of a story about a river and the people that came to see it. " * 40)) is None


def test_equal_cosines_give_the_first_licence():
    idf = dict.fromkeys(licenses.VOCABULARY, 1.0)
    index = licenses.Index([("B", {"license": 1}), ("A", {"license": 1})], idf, 0.8)
    assert index.best(["license"]) == (1.0, "A")
