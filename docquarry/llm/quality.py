"""Operator 1, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words, covering the whole text.  Every passage is
encoded as a vector of character-class shares, word-repetition shares, lexicon scores and the mean of its words'
embeddings (EMBED leading right singular vectors of the sample's TF-IDF passages, hashed words); a gated attention layer, learned from document labels alone, weighs the
passages; the weighted mean passage is scored by a logistic layer.  There is one
such model for low quality and one for toxicity, each with its own attention, so
that a few bad words in one of a thousand passages can decide.

The embeddings, the lexicon, the layers and the thresholds are fitted on the driver from a sample of
at most max_labelled labelled documents of the table (a documented bound: fitting needs no
more); everything else is one pass over the documents without a shuffle.

Defined results: a text that is null or has no word has no passages, quality 0, toxicity
0 and is rejected.  Rows repeat as often as the input repeats them.  Without
usable labels (none, one class only, or none of documents in the table) that model scores nothing: its score is null and it
rejects nothing.  Labels that are null are not used; a document with conflicting
labels counts as bad; of a doc_id that repeats, the first text in order is fitted on.  Of passages of equal attention
the first is the worst.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import blocks

PASSAGE_WORDS = 64
MAX_LABELLED = 3000
HIDDEN = 16
LEXICON_BITS = 16
EMBED = 16
DECAY = 5e-3
#: Share of held-out good documents that a threshold may reject.
GOOD_LOST = 0.002

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _POINT, _BANG, _BAR, _OTHER = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:] = _LOWER
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = _SPACE, _LINE
_CLASS[[ord(c) for c in ".,;:'\"?()-"]], _CLASS[ord("!")], _CLASS[ord("|")] = _POINT, _BANG, _BAR
N_SHAPE = 9 + 4


@dataclass(eq=False)
class Lexicon:
    """Words that tell classes apart, in a direct-mapped table: key and weight by hash."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(1 << LEXICON_BITS, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << LEXICON_BITS, np.float32))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64((1 << LEXICON_BITS) - 1)).astype(np.int64)
        return np.where(self.keys[at] == hashes, self.weights[at], np.float32(0))


@dataclass(eq=False)
class Head:
    lexicon: Lexicon
    mean: np.ndarray
    std: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float
    threshold: float = 0.5

    def score(self, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each bag, and the attention of each passage."""
        x = (x - self.mean) / self.std
        a = _softmax((np.tanh(x @ self.v) * _sigmoid(x @ self.u)) @ self.w, offsets)
        s = np.zeros(len(offsets) - 1)
        full = np.diff(offsets) > 0
        if full.any():
            s[full] = np.add.reduceat(a * (x @ self.c), offsets[:-1][full])
        return _sigmoid(s + self.b), a


@dataclass(eq=False)
class Model:
    """Heads for low quality and for toxicity (None if there was nothing to learn from), and the words' embeddings."""

    heads: list[Head | None]
    words: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _softmax(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    full = size > 0
    if not full.any():
        return x
    at, n = offsets[:-1][full], size[full]
    e = np.exp(x - np.repeat(np.maximum.reduceat(x, at), n))
    return e / np.repeat(np.add.reduceat(e, at), n)


def learn_embedding(w: blocks.Words, size: int = EMBED, seed: int = 3) -> np.ndarray:
    """A vector for each slot of word hashes, by a randomised SVD of the sample's TF-IDF passages; zero for other words."""
    slots = 1 << LEXICON_BITS
    n = -(-np.diff(w.offsets) // PASSAGE_WORDS)
    first = np.concatenate([[0], np.cumsum(n)])
    passage = np.repeat(first[:-1] - w.offsets[:-1] // PASSAGE_WORDS, np.diff(w.offsets)) * PASSAGE_WORDS + np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1] % PASSAGE_WORDS, np.diff(w.offsets))
    key, tf = np.unique((passage // PASSAGE_WORDS << LEXICON_BITS) | (w.hashes & np.uint64(slots - 1)).astype(np.int64), return_counts=True)
    row, slot = key >> LEXICON_BITS, key & (slots - 1)
    if not len(key):
        return np.zeros((slots, size), np.float32)
    df = np.bincount(slot, minlength=slots)
    idf = np.log((1 + first[-1]) / (1 + df)) + 1
    x = (1 + np.log(tf)) * idf[slot]
    x /= np.sqrt(np.bincount(row, x * x))[row]
    omega = np.random.default_rng(seed).standard_normal((size + 8, slots))
    q = np.linalg.qr(np.stack([np.bincount(row, o[slot] * x, int(first[-1])) for o in omega], 1))[0]
    b = np.stack([np.bincount(slot, c[row] * x, slots) for c in q.T], 1)
    u = np.linalg.svd(b, full_matrices=False)[0][:, :size] * (idf * (df > 0))[:, None] * 100
    out = np.zeros((slots, size), np.float32)
    out[:, : u.shape[1]] = u
    return out


def encode(data: np.ndarray, bounds: np.ndarray, w: blocks.Words, lexicons: list[Lexicon], words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each lexicon a vector per passage; passages' offsets by document.

    The characters between the words belong to the passage of the word before
    them, those before a document's first word to its first passage.
    """
    count = np.diff(w.offsets)
    n = -(-count // PASSAGE_WORDS)
    offsets = np.concatenate([[0], np.cumsum(n)])
    total = int(offsets[-1])
    if not total:
        return [np.zeros((0, N_SHAPE + 2 + EMBED))] * len(lexicons), offsets
    first = np.repeat(w.offsets[:-1] - offsets[:-1] * PASSAGE_WORDS, n) + np.arange(total) * PASSAGE_WORDS
    doc = np.repeat(np.arange(len(n)), n)
    start = w.starts[first]
    start[offsets[:-1][n > 0]] = bounds[:-1][n > 0]
    end = np.append(start[1:], 0)
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = bounds[1:][doc[last]]
    # passages cover all bytes but those of documents without a word
    edges = np.concatenate([[0], np.stack([start, end], 1).ravel(), [len(data)]])
    owners = np.full(2 * total + 1, total)
    owners[1::2] = np.arange(total)
    owner = np.repeat(owners, np.diff(edges))
    shares = np.bincount(owner * 9 + _CLASS[data], minlength=(total + 1) * 9)[: total * 9].reshape(total, 9) / np.maximum(end - start, 1)[:, None]
    size = np.diff(np.append(first, len(w.hashes)))
    same1 = np.zeros(len(w.hashes), np.float32)
    same1[1:] = w.hashes[1:] == w.hashes[:-1]
    same2 = np.zeros(len(w.hashes), np.float32)
    same2[2:] = w.hashes[2:] == w.hashes[:-2]
    begins = w.offsets[:-1][count > 0]  # a document's words are not compared with the one before
    same1[begins] = same2[begins] = 0
    same2[begins[count[count > 0] > 1] + 1] = 0
    lens = (w.ends - w.starts).astype(np.float32)
    per = np.stack([np.add.reduceat(x, first) / size for x in (same1, same2, lens, lens > 12)], 1)
    per[:, 2] /= 10
    shape = np.hstack([np.sqrt(shares), per])
    meaning = np.add.reduceat(words[(w.hashes & np.uint64(len(words) - 1)).astype(np.int64)], first) / size[:, None]
    out = []
    for lexicon in lexicons:
        v = lexicon.of(w.hashes)
        out.append(np.hstack([shape, (np.add.reduceat(v, first) / size)[:, None], np.maximum.reduceat(v, first)[:, None], meaning]))
    return out, offsets


def learn_lexicon(w: blocks.Words, bad: np.ndarray, rows: np.ndarray, least: int = 5, most: int = 4096) -> Lexicon:
    """Weights: smoothed log ratio of the shares of bad and of other documents that have a word."""
    doc = w.doc_of()
    keep = rows[doc]
    pair = np.unique(np.stack([w.hashes[keep], doc[keep].astype(np.uint64)]), axis=1)
    words, at, n = np.unique(pair[0], return_index=True, return_counts=True)
    n_bad = np.add.reduceat(bad[pair[1].astype(np.int64)].astype(np.int64), at) if len(at) else n
    b, g = max(int((bad & rows).sum()), 1), max(int((~bad & rows).sum()), 1)
    ratio = np.log((n_bad + 0.5) / (b + 1)) - np.log((n - n_bad + 0.5) / (g + 1))
    # signed root of the likelihood gain: large only where a word is frequent enough and telling
    z = (n_bad / b - (n - n_bad) / g) / np.sqrt(n / (b + g) * (1 / b + 1 / g) + 1e-9)
    pick = np.flatnonzero((n >= least) & (np.abs(z) > 4))
    pick = pick[np.argsort(np.abs(z[pick]))][-most:]
    lexicon = Lexicon()
    slot = (words[pick] & np.uint64((1 << LEXICON_BITS) - 1)).astype(np.int64)
    lexicon.keys[slot], lexicon.weights[slot] = words[pick], ratio[pick]  # the most telling of a slot is last
    return lexicon


def learn_head(x: np.ndarray, offsets: np.ndarray, bad: np.ndarray, rows: np.ndarray, lexicon: Lexicon, rounds: int = 100, seed: int = 7) -> Head:
    """Gated attention and logistic layer by Adam on the whole sample, classes weighted alike."""
    rng = np.random.default_rng(seed)
    use = np.flatnonzero(rows & (np.diff(offsets) > 0))
    size = np.diff(offsets)[use]
    at = np.concatenate([[0], np.cumsum(size)])
    z = x[np.repeat(offsets[use] - at[:-1], size) + np.arange(at[-1])]
    mean, std = z.mean(0), z.std(0) + 1e-3
    z = np.clip((z - mean) / std, -30, 30)
    y = bad[use].astype(float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    d = z.shape[1]
    p = {"v": rng.normal(0, 0.3, (d, HIDDEN)), "u": rng.normal(0, 0.3, (d, HIDDEN)), "w": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(d), "b": np.zeros(1)}
    m, s = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for t in range(1, rounds + 1):
        th, sg = np.tanh(z @ p["v"]), _sigmoid(z @ p["u"])
        g = th * sg
        a = _softmax(g @ p["w"], at)
        e = z @ p["c"]
        bag = np.add.reduceat(a * e, at[:-1])
        err = (_sigmoid(bag + p["b"]) - y) * weight
        up = np.repeat(err, size)
        da = up * a * (e - np.repeat(bag, size))  # through the softmax
        dg = da[:, None] * p["w"]
        grad = {"b": np.array([err.sum()]), "c": z.T @ (up * a) + DECAY * p["c"], "w": g.T @ da + DECAY * p["w"], "v": z.T @ (dg * sg * (1 - th * th)) + DECAY * p["v"], "u": z.T @ (dg * th * sg * (1 - sg)) + DECAY * p["u"]}
        for k in p:
            m[k] += 0.1 * (grad[k] - m[k])
            s[k] += 0.01 * (grad[k] ** 2 - s[k])
            p[k] -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    return Head(lexicon, mean, std, p["v"], p["u"], p["w"], p["c"], float(p["b"][0]))


def _threshold(score: np.ndarray, bad: np.ndarray) -> float:
    """Best balanced accuracy among thresholds that reject at most GOOD_LOST of the good ones."""
    best, at = -1.0, 0.5
    good = np.sort(score[~bad])
    for t in np.linspace(0.05, 0.95, 91):
        lost = 1 - np.searchsorted(good, t) / max(len(good), 1)
        if lost <= GOOD_LOST and (gain := (score[bad] >= t).mean() - lost - abs(t - 0.5) * 1e-3) > best:
            best, at = gain, float(t)
    return at


def fit(texts: pa.Array, bad_quality: np.ndarray, bad_toxic: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> Model:
    """Heads for low quality and for toxicity; a fifth of the sample is held out for the thresholds."""
    parts = list(blocks.worded(texts))
    if not parts:
        return Model([None, None], np.zeros((1, EMBED), np.float32))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[4].offsets) for p in parts]))])
    w = blocks.Words(np.concatenate([p[4].hashes for p in parts]), np.zeros(0), np.zeros(0), offsets)
    held = np.arange(len(offsets) - 1) % 5 == 0
    heads: list[Head | None] = []
    words = learn_embedding(w)
    for bad, have in ((bad_quality, known[0]), (bad_toxic, known[1])):
        rows = have & ~held
        if min((bad & rows).sum(), (~bad & rows).sum()) < 2:
            heads.append(None)
            continue
        lexicon = learn_lexicon(w, bad, rows)
        x, at = [], [np.zeros(1, np.int64)]
        for _, _, data, bounds, own in parts:
            (v,), o = encode(data, bounds, own, [lexicon], words)
            x.append(v)
            at.append(o[1:] + at[-1][-1])
        z, o = np.concatenate(x), np.concatenate(at)
        head = learn_head(z, o, bad, rows, lexicon)
        check = have & held
        if min((bad & check).sum(), (~bad & check).sum()) >= 5:
            head.threshold = _threshold(head.score(z, o)[0][check], bad[check])
        heads.append(head)
    return Model(heads, words)


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on at most max_labelled labelled documents, those of the lowest hash of doc_id."""
    l = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    l = l.join(blocks.narrow(documents, "doc_id"), "doc_id", "left_semi")
    picked = l.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = blocks.narrow(documents, "doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    sample = rows.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    of = lambda c: np.array([-1 if v is None else v for v in sample.column(c).to_pylist()], int)
    q, t = of("quality"), of("toxic")
    return fit(sample.column("text"), q == 0, t == 1, (q >= 0, t >= 0))


def _scored(column: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """Results by row for one text column."""
    n = len(column)
    out = {"passages": np.zeros(n, np.int32), "quality": np.zeros(n), "toxicity": np.zeros(n), "worst_passage": np.full(n, -1, np.int32), "keep": np.zeros(n, bool)}
    heads = model.heads
    real = [h for h in heads if h is not None]
    for a, b, data, bounds, w in blocks.worded(column):
        vectors, offsets = encode(data, bounds, w, [h.lexicon for h in real] or [Lexicon()], model.words)
        size = np.diff(offsets)
        out["passages"][a:b] = size
        keep = size > 0
        for k, head in enumerate(heads):
            name = ("quality", "toxicity")[k]
            if head is None:
                out[name][a:b] = np.where(size > 0, np.nan, 0)
                continue
            p, att = head.score(vectors[real.index(head)], offsets)
            p = np.round(p, 9)  # so that repeated rows agree wherever they stand
            keep &= p < head.threshold
            out[name][a:b] = np.where(size > 0, 1 - p if k == 0 else p, 0)
            if k == 0 or heads[0] is None:
                order = np.lexsort((-att, np.repeat(np.arange(b - a), size)))
                out["worst_passage"][a:b][size > 0] = order[offsets[:-1][size > 0]] - offsets[:-1][size > 0]
        out["keep"][a:b] = keep
    return out


SCHEMA = "doc_id long, passages int, quality double, toxicity double, worst_passage int, keep boolean"


def classify(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """A row per document: passages, quality (1 good), toxicity (1 toxic), the passage of
    most attention (-1 if none), and whether the document is kept."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, max_labelled))

    def run(batches):
        for batch in batches:
            r = _scored(batch.column("text"), model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(r["passages"]), *(pa.array(r[k], mask=np.isnan(r[k])) for k in ("quality", "toxicity")), pa.array(r["worst_passage"]), pa.array(r["keep"])], names=["doc_id", "passages", "quality", "toxicity", "worst_passage", "keep"])

    return blocks.narrow(documents, "doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of documents, with all their columns, that the classifier keeps."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, max_labelled))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column("text"), model.value)["keep"]))

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
