import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.errors import ConfigurationError, VectorizationError
from docquarry.functions import chunk, clean, jsonrepair, security, similarity, tokens
from docquarry.operators import vectorizers


def texts(strategy, text, size, overlap, **options):
    return [v for v, _ in chunk.generate_chunks(text, strategy, size, overlap, **options)]


def test_character_chunks_of_known_texts():
    assert texts("character", "abcdefghijklmnopqrstuvwxyz", 10, 3) == ["abcdefghij", "hijklmnopq", "opqrstuvwx", "vwxyz"]
    assert texts("character", "abcde fghij klmno", 5, 0) == ["abcde", " fghi", "j klm", "no"]
    assert texts("character", "short", 10, 2) == ["short"] and texts("character", "exactsize!", 10, 2) == ["exactsize!"]
    got = texts("character", "1234567890", 5, 4)
    assert len(got) == 6 and got[0] == "12345" and got[-1] == "67890"
    assert texts("character", "", 5, 1) == []
    with pytest.raises(ValueError):
        texts("character", "abc", 5, 5)


def test_character_expression_equals_python(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("ab é😀\n") for _ in range(rng.randrange(40)))) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, overlap, before, after in ((5, 0, 0, 0), (7, 3, 2, 1), (4, 3, 0, 5)):
        got = {}
        for r in chunk.chunk(df, "character", size, overlap, expand_before=before, expand_after=after).collect():
            got.setdefault(r.doc_id, {})[r.chunk_seq] = (r.vector_text, r.storage_text)
        for k, text in rows:
            want = chunk.generate_chunks(text or "", "character", size, overlap, before, after)
            assert [got.get(k, {})[i] for i in sorted(got.get(k, {}))] == want


def test_token_chunks():
    tok = tokens.PieceTokenizer()
    words = " ".join(f"w{k}" for k in range(60))
    got = texts("token", words, 384, 50, tokenizer=tok)
    # the last window is followed by a chunk of its last overlap tokens
    assert len(got) == 2 and got[0] == words and got[1] == "".join(tok.encode(words)[-50:])
    lined = "a b c d e f g\nh i j k"
    assert texts("token", lined, 8, 0, tokenizer=tok)[0] == "a b c d e f g\n"
    with pytest.raises(ValueError):
        texts("token", "a", 5, 1)


def test_paragraph_chunks():
    assert texts("paragraph", "aaaa\n\nbbbb\n \ncccc", 8, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert texts("paragraph", "aaaa\n\nbbbb\n\ncccc", 8, 4) == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]
    assert texts("paragraph", "One two. Three four. Five.", 12, 0) == ["One two.", "Three four.", "Five."]
    assert texts("paragraph", "One two. Three four.", 12, 0, strict_size=False) == ["One two. Three four."]
    assert texts("paragraph", " \n\n ", 5, 0) == []


def test_recursive_and_semantic_chunks():
    # the joiner counts for the first piece too, but not for the first after a cut
    assert texts("recursive", "aa bb cc", 5, 0) == ["aa", "bb cc"]
    assert texts("recursive", "aa\n\nbb", 10, 3) == ["aa\n\nbb"]
    assert "".join(texts("recursive", "x" * 12, 5, 0)) == "x" * 12
    embed = lambda ts: [[1.0, 0.0] if "cat" in t else [0.0, 1.0] for t in ts]
    assert texts("semantic", "cat a\n\ncat b\n\ndog\n\ndog", 100, 0, vectorizer_fn=embed, initial_semantic_blocks=1) == ["cat a\n\ncat b", "dog\n\ndog"]
    with pytest.raises(ValueError):
        texts("semantic", "a", 5, 0)
    with pytest.raises(ValueError):
        texts("other", "a", 5, 0)


def python_clean(text):
    if not isinstance(text, str):
        return ""
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    text = re.sub(r"\.{4,}", "...", text)
    lines = []
    for line in text.split("\n"):
        rest = line.lstrip()
        lines.append(line[: len(line) - len(rest)] + re.sub(" {2,}", " ", rest))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def test_cleaning_equals_python(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ab  .\r\n\t\x00 é") for _ in range(rng.randrange(60)))) for k in range(200)] + [(900, None), (901, "")]
    got = spark.createDataFrame(rows, "k long, t string").select("k", clean.basic_clean(F.col("t")).alias("c")).collect()
    assert {r.k: r.c for r in got} == {k: python_clean(t) for k, t in rows}
    assert clean.get_cleaner("basic") is clean.basic_clean
    with pytest.raises(ValueError):
        clean.get_cleaner("other")
    with pytest.raises(TypeError):
        clean.get_cleaner(3)


def test_similarity(spark):
    q, m = np.array([1.0, 0.0], np.float32), np.array([[2.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0]], np.float32)
    assert similarity.cosine_similarity(q, m).tolist() == [1, 0, -1, 0]
    assert len(similarity.cosine_similarity(q, np.zeros((0, 2), np.float32))) == 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "k int, v array<float>")
    got = {r.k: r.s for r in df.select("k", similarity.cosine(F.col("v"), F.lit([1.0, 0.0])).alias("s")).collect()}
    assert got == {0: 1, 1: 0, 2: -1, 3: 0}
    with pytest.raises(TypeError):
        similarity.cosine_similarity([1], m)
    with pytest.raises(ValueError):
        similarity.cosine_similarity(np.zeros(3), m)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('x ```json\n{"a": [1, 2,],}\n``` y', {"a": [1, 2]}), ("{'a': True, b: None}", {"a": True, "b": None}), ('{"a": [1, {"b": 2', {"a": [1, {"b": 2}]}),
        ('Sure: {"a": "it\'s", // why\n "b": ...}', {"a": "it's", "b": None}), ("{“a”: 1}", {"a": 1}),
    ],
)
def test_json_repair(text, want):
    assert jsonrepair.parse_json(text) == want


def test_json_without_repair():
    for text in ("", "no braces", None):
        with pytest.raises(ValueError):
            jsonrepair.parse_json(text)


def test_encryption(spark):
    key, other = security.derive_key("secret", b"s" * 16), security.derive_key("wrong", b"s" * 16)
    df = spark.createDataFrame([("grüße",), ("",), (None,)], "t string").select("t", security.encrypt(F.col("t"), key).alias("e"))
    rows = df.select("t", "e", security.decrypt(F.col("e"), key).alias("back"), security.decrypt(F.col("e"), other).alias("bad"), security.decrypt(F.col("e"), None).alias("none")).collect()
    for r in rows:
        assert r.back == r.t
        assert r.t is None or (r.bad == security.NOT_DECRYPTED and r.none == security.KEY_MISSING and r.t.encode() != bytes(r.e))
    assert security.derive_key(None, b"") is None
    with pytest.raises(ValueError):
        security.derive_key("", b"s")


def test_tokenizers():
    tok = tokens.get_tokenizer(None)
    assert tok.decode(tok.encode("a  b\nc, d")) == "a  b\nc, d"
    for bad in ({"name": "other"}, {"name": "tiktoken"}, "x", {"name": "ranks", "model": "/nowhere"}):
        with pytest.raises(ConfigurationError):
            tokens.get_tokenizer(bad)


def test_vectorizers(spark):
    v = vectorizers.get_vectorizer("hashing", {"dim": 16})
    assert v is vectorizers.get_vectorizer("hashing", {"dim": 16}) and v.vectorize(["a b", ""]).shape == (2, 16) and not v.vectorize([""]).any()
    assert vectorizers.unique_name("tfidf", {"b": 1, "a": 2}) == 'tf_idf:{"a":2,"b":1}'
    with pytest.raises(ConfigurationError):
        vectorizers.get_vectorizer("nothing")
    with pytest.raises(VectorizationError):
        vectorizers.TfIdfVectorizer().vectorize(["a"])
    df = spark.createDataFrame([(0, "The cat sat"), (1, "the dog"), (2, None)], "k long, text string")
    t = vectorizers.TfIdfVectorizer().fit(df)
    assert list(t.idf) == ["cat", "dog", "sat", "the"] and t.idf["the"] == pytest.approx(np.log(4 / 3) + 1)
    dense = t.vectorize(["The cat sat", "the dog"])
    sparse = {(r.k, r.term): r.weight for r in vectorizers.tfidf(df, "k").collect()}
    assert {(k, w): pytest.approx(float(dense[k, list(t.idf).index(w)]), abs=1e-6) for k, w in sparse} == sparse
    calls = []

    def post(url, body, headers):
        calls.append(body["input"])
        return {"data": [{"index": k, "embedding": [1.0, float(len(t))]} for k, t in enumerate(body["input"])]}

    h = vectorizers.HttpVectorizer("openai", "m", "http://x", post=post)
    assert h.vectorize(["ab", " "]).tolist() == [[1, 2], [0, 0]] and calls == [["hello world"], ["ab"]]
