"""Vectorizers: text to vectors, run as Arrow batches; TF-IDF as a DataFrame model."""

from __future__ import annotations

import hashlib
import importlib
import json
import re
import urllib.request
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.errors import ConfigurationError, VectorizationError

TERM = "[\\p{L}\\p{N}_]{2,}"


class Vectorizer:
    """vectorize(list of texts) gives a float32 matrix of dim columns."""

    dim: int
    dtype = np.dtype("float32")

    def vectorize(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def get_tokenizer(self):
        return None

    @staticmethod
    def list_models(**config) -> list[str]:
        return []


class HashingVectorizer(Vectorizer):
    """Signed hashed words and pairs of words, of unit length; it needs no fitting and no model."""

    def __init__(self, dim: int = 256):
        if dim < 1:
            raise ConfigurationError("dim must be positive")
        self.dim = dim

    def vectorize(self, texts: list[str]) -> np.ndarray:
        out, hashed, known, size = np.zeros((len(texts), self.dim), np.float32), hashlib.blake2b, {}, 8
        for k, text in enumerate(texts):
            words = re.findall(r"\w+", (text or "").lower())
            digests = [hashed(t.encode(), digest_size=size).digest() for t in map(" ".join, zip(words, words[1:], strict=False))]
            for w in words:  # single words come again and again, pairs don't
                if (d := known.get(w)) is None:
                    d = known[w] = hashed(w.encode(), digest_size=size).digest()
                digests.append(d)
            h = np.frombuffer(b"".join(digests), "<u8")
            out[k] = np.bincount((h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


class TfIdfVectorizer(Vectorizer):
    """Raw counts times smoothed idf, unit length, vocabulary in order; fitted on a DataFrame."""

    def __init__(self, idf: dict[str, float] | None = None):
        self.idf = dict(sorted(idf.items())) if idf is not None else None

    @property
    def dim(self) -> int:  # type: ignore[override]
        if self.idf is None:
            raise VectorizationError("TF-IDF isn't fitted yet")
        return len(self.idf)

    def fit(self, df: DataFrame, text: str = "text") -> TfIdfVectorizer:
        """The vocabulary comes to the driver: use tfidf() where it may be large."""
        rows = document_frequencies(df, text).select("term", "idf").toArrow()
        if not rows.num_rows:
            raise VectorizationError("no terms to fit TF-IDF on")
        self.idf = dict(sorted(zip(rows.column("term").to_pylist(), rows.column("idf").to_pylist(), strict=True)))
        return self

    def vectorize(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        at = {t: k for k, t in enumerate(self.idf)}
        weights = np.array(list(self.idf.values()))
        for k, text in enumerate(texts):
            for term in re.findall(r"\w\w+", (text or "").lower()):
                if term in at:
                    out[k, at[term]] += 1
        out *= weights
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


class HttpVectorizer(Vectorizer):
    """An embeddings service.  style is 'openai' (also for compatible servers), 'ollama' or 'cohere'.

    Blank texts are zero vectors and aren't sent; the dimension is that of a probe.
    """

    def __init__(self, style: str, model: str, base_url: str, api_key: str | None = None, post: Callable[[str, dict, dict], dict] | None = None, **options):
        if not model:
            raise ConfigurationError("a model must be named")
        if style == "cohere":
            options.setdefault("input_type", "search_document")
            options.setdefault("truncate", "END")
            if options["input_type"] not in ("search_document", "search_query", "classification", "clustering"):
                raise ConfigurationError(f"unknown input_type: {options['input_type']}")
            if options["truncate"] not in ("NONE", "START", "END"):
                raise ConfigurationError(f"unknown truncate: {options['truncate']}")
        self.style, self.model, self.url, self.key, self.options = style, model, base_url.rstrip("/"), api_key, options
        self._post = post
        self.dim = len(self._ask(["hello world"])[0])

    def _send(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            if self._post:
                return self._post(self.url + path, body, headers)
            with urllib.request.urlopen(urllib.request.Request(self.url + path, json.dumps(body).encode(), headers), timeout=120) as r:
                return json.load(r)
        except Exception as e:
            raise VectorizationError(f"{self.style}: {e}") from e

    def _ask(self, texts: list[str]) -> list[list[float]]:
        if self.style == "ollama":
            return [self._send("/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in texts]
        if self.style == "cohere":
            return self._send("/v1/embed", {"model": self.model, "texts": [t.strip() for t in texts], **self.options})["embeddings"]
        got = self._send("/embeddings", {"model": self.model, "input": texts, **self.options})["data"]
        return [x["embedding"] for x in sorted(got, key=lambda x: x.get("index", 0))]

    def vectorize(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        some = [k for k, t in enumerate(texts) if t and t.strip()]
        if some:
            got = self._ask([texts[k] for k in some])
            if len(got) != len(some) or any(len(v) != self.dim for v in got):
                raise VectorizationError(f"{self.style}: {len(got)} vectors for {len(some)} texts, or another dimension than {self.dim}")
            out[some] = got
        return out


def _http(style: str, url: str):
    return lambda **c: HttpVectorizer(style, c.pop("model", ""), c.pop("base_url", None) or c.pop("host", None) or url, c.pop("api_key", None), **c)


def _sentence(**config) -> Vectorizer:
    model = importlib.import_module("sentence_transformers").SentenceTransformer(config.get("model", "all-MiniLM-L6-v2"))

    class Sentence(Vectorizer):
        dim = model.get_sentence_embedding_dimension()

        def vectorize(self, texts):
            return np.asarray(model.encode(list(texts), convert_to_numpy=True), np.float32)

    return Sentence()


_ALIASES = {"st": "sentence_transformer", "tfidf": "tf_idf"}
_FACTORIES: dict[str, Callable[..., Vectorizer]] = {
    "hashing": HashingVectorizer, "tf_idf": lambda **_: TfIdfVectorizer(), "sentence_transformer": _sentence, "openai": _http("openai", "https://api.openai.com/v1"),
    "openai_compatible": _http("openai", "http://localhost:8000/v1"), "ollama": _http("ollama", "http://localhost:11434"), "cohere": _http("cohere", "https://api.cohere.ai"),
}
_MADE: dict[str, Vectorizer] = {}


def register_vectorizer(name: str, factory: Callable[..., Vectorizer]) -> None:
    _FACTORIES[name] = factory


def list_vectorizers() -> list[str]:
    return sorted(_FACTORIES)


SECRETS = ("api_key", "token", "password", "secret")


def public(config: dict | None) -> dict:
    """The settings without those that nobody else should see."""
    return {k: v for k, v in (config or {}).items() if not any(s in k.lower() for s in SECRETS)}


def unique_name(name: str, config: dict | None = None) -> str:
    """Names a vectorizer and its settings; a key or password is no part of it."""
    name, config = _ALIASES.get(name, name), public(config)
    return name if not config else f"{name}:{json.dumps(config, sort_keys=True, separators=(',', ':'))}"


def get_vectorizer(name: str, config: dict | None = None) -> Vectorizer:
    """One instance per name and settings; a TF-IDF model is a new one each time, as it is fitted."""
    key, kind = unique_name(name, config) + json.dumps({k: v for k, v in (config or {}).items() if k not in public(config)}, sort_keys=True), _ALIASES.get(name, name)
    if key in _MADE:
        return _MADE[key]
    if kind not in _FACTORIES:
        raise ConfigurationError(f"unknown vectorizer: {name}")
    try:
        made = _FACTORIES[kind](**(config or {}))
    except (ImportError, FileNotFoundError) as e:
        raise ConfigurationError(f"vectorizer {name} isn't available: {e}") from e
    except (ConfigurationError, VectorizationError):
        raise
    except Exception as e:
        raise VectorizationError(f"vectorizer {name}: {e}") from e
    if not isinstance(made, Vectorizer):
        raise ConfigurationError(f"{name} doesn't make a Vectorizer")
    if kind != "tf_idf":
        _MADE[key] = made
    return made


def embed(df: DataFrame, vectorizer: Vectorizer, text: str = "text", into: str = "embedding") -> DataFrame:
    """df with a vector of each text, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(vectorizer)

    def run(batches):
        for batch in batches:
            vectors = shared.value.vectorize([t or "" for t in batch.column(text).to_pylist()])
            flat = pa.array(np.asarray(vectors, np.float32).ravel(), pa.float32())
            offsets = pa.array(np.arange(batch.num_rows + 1) * vectors.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*batch.schema.names, into])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{into}` array<float>")


def terms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), 0)
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf) with idf ln((1 + rows) / (1 + df)) + 1; the rows with a term are counted without moving any text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), 0))
    n = df.count()
    found = df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return found.withColumn("idf", F.ln(F.lit(1.0 + n) / (F.col("df") + 1)) + 1)


def tfidf(df: DataFrame, key: str, text: str = "text", model: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): sparse unit vectors.  Terms without a row in model are left out."""
    model = model if model is not None else document_frequencies(df, text)
    w = terms(df, key, text).join(model.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))
