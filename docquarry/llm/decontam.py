"""Operator 4, benchmark decontamination: latent semantic retrieval, then sequence checks.

1. Passages of PASSAGE_WORDS words of all documents are TF-IDF vectors over hashed terms
   (document frequencies counted over the whole corpus, one pass).
2. A distributed randomised SVD finds their leading right singular subspace: in one more
   pass every task adds up its share of A'(A Omega), Omega a fixed Gaussian matrix; the sum,
   of fixed size whatever the corpus, is turned into V and the singular values on the driver
   (Nystrom form of the factorisation).
3. A third pass slides windows of WINDOW words over each document, projects them with V and
   compares them by cosine with all windows of the benchmark items; every place of an item
   that has MIN_COSINE is a candidate.  For an item of fewer words than WINDOW, windows are as short
   as the item.  A stretch of text is compared only with the items of which it has LCS_MAYBE of
   the words, in any order: no region in it could pass the sequence check below with another.
4. Candidates are verified on the words: longest common subsequence of the item and the
   surroundings of the window, as a share of the item.  LCS_SURE and more is a leak.  From
   LCS_MAYBE it is one (a paraphrase) if the item's answer is there too: the words of
   its last sentence that are rare in the corpus, at least ANSWER of them, in the same region.

The three passes shuffle only fixed-size partial sums.  Benchmark items, the model and the
vocabulary are broadcast; they grow with the benchmark, whose size is checked against
MAX_ITEMS and MAX_ITEMS_BYTES; a larger one is processed in parts, each in a third pass of its own.

Defined results: null and empty texts match nothing and stay; items with fewer than MIN_ITEM
words (or null) are never leaked; repeated documents are judged alike; a duplicated item
is reported under each of its ids; an empty benchmark or corpus gives no match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import blocks

TERM_BITS = 15
RANK = 32
PASSAGE_WORDS = 32
WINDOW, ITEM_STRIDE = 16, 1
MIN_COSINE = 0.6
LCS_SURE, LCS_MAYBE, ANSWER = 0.75, 0.6, 0.6
MIN_ITEM = 8
MAX_ITEMS, MAX_ITEMS_BYTES = 2000, 1 << 20
_MASK = np.uint64((1 << TERM_BITS) - 1)


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _MASK).astype(np.int64)


def entries(w: blocks.Words, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passage, term and count of all distinct (passage, term), by passage; and the passages."""
    n = -(-np.diff(w.offsets) // size)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], np.diff(w.offsets))
    passage = np.repeat(first[:-1], np.diff(w.offsets)) + at // size
    key = np.sort((passage << TERM_BITS) | _terms(w.hashes))
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    return key[edge] >> TERM_BITS, key[edge] & int(_MASK), np.diff(np.append(edge, len(key))), int(first[-1])


def count_passages(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Passages that have each term, over the corpus, and the number of passages."""

    def run(batches):
        total = np.zeros((1 << TERM_BITS) + 1)
        for batch in batches:
            for *_, w in blocks.worded(batch.column("text")):
                _, term, _, n = entries(w)
                total[:-1] += np.bincount(term, minlength=1 << TERM_BITS)
                total[-1] += n
        yield 0, total

    (got,) = blocks.sum_arrays(docs, run, "f8", 1)
    return (np.zeros(1 << TERM_BITS), 0.0) if got is None else (got[:-1], float(got[-1]))


def idf_of(df: np.ndarray, n: float) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def weigh(passage: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """Weights of entries: (1 + ln tf) idf, passages scaled to length 1."""
    x = ((1 + np.log(count)) * idf[term]).astype(np.float32)
    norm = np.sqrt(np.bincount(passage, x * x, n)) + 1e-12
    return (x / norm[passage]).astype(np.float32)


def gaussian(rank: int = RANK, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((1 << TERM_BITS, rank), dtype=np.float32)


def svd(docs: DataFrame, idf: np.ndarray, rank: int = RANK, parts: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """V (terms x rank) and singular values of the passages' TF-IDF matrix."""
    known = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        omega, out = gaussian(rank), np.zeros((1 << TERM_BITS, rank), np.float32)
        for batch in batches:
            for *_, w in blocks.worded(batch.column("text")):
                passage, term, count, n = entries(w)
                if not n:
                    continue
                x = weigh(passage, term, count, n, known.value)
                y = np.add.reduceat(omega[term] * x[:, None], np.flatnonzero(np.diff(passage, prepend=-1)))
                order = np.argsort(term, kind="stable")
                t = term[order]
                edge = np.flatnonzero(np.diff(t, prepend=-1))
                out[t[edge]] += np.add.reduceat(y[passage[order]] * x[order, None], edge)
        step = (1 << TERM_BITS) // parts
        for b in range(parts):
            yield b, out[b * step : (b + 1) * step]

    got = blocks.sum_arrays(docs, run, "f4", parts)
    if any(g is None for g in got):
        return np.zeros((1 << TERM_BITS, rank), np.float32), np.zeros(rank)
    return factor(np.concatenate([g.reshape(-1, rank) for g in got]).astype(float), gaussian(rank).astype(float))


def factor(y: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """V and singular values of A from y = A'A omega (shifted Nystrom)."""
    if not np.abs(y).any():
        return np.zeros(y.shape, np.float32), np.zeros(y.shape[1])
    shift = 1e-7 * np.linalg.norm(y)
    y = y + shift * omega
    m = omega.T @ y
    ev, q = np.linalg.eigh((m + m.T) / 2)
    good = ev > ev.max() * 1e-12
    b = y @ (q[:, good] / np.sqrt(ev[good]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    v = np.zeros(y.shape, np.float32)
    v[:, : u.shape[1]] = u
    sigma = np.zeros(y.shape[1])
    sigma[: len(s)] = np.sqrt(np.maximum(s * s - shift, 0))
    return v, sigma


@dataclass(eq=False)
class Items:
    """Benchmark items, ready to search: words, answers, windows' projections, vocabulary table."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vectors: np.ndarray
    range_of: np.ndarray  # items + 1, into vectors
    start_of: np.ndarray
    vocabulary: np.ndarray  # sorted
    has: np.ndarray  # occurrences: vocabulary + 1 (no word) x items
    need: np.ndarray  # words that a region must share with the item


def windows(count: np.ndarray, offsets: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of windows; the last one ends at the document's end."""
    n = np.where(count > size, -(-(count - size) // stride) + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(count)), n)
    at = np.minimum((np.arange(first[-1]) - first[doc]) * stride, np.maximum(count[doc] - size, 0))
    return doc, offsets[doc] + at, np.minimum(count[doc], size)


def project(hashes: np.ndarray, first: np.ndarray, size: np.ndarray, idf: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Unit vectors of windows of words in the latent space."""
    if not len(first):
        return np.zeros((0, v.shape[1]), np.float32)
    own = np.repeat(np.arange(len(first)), size)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    key = np.sort((own << TERM_BITS) | _terms(hashes[at]))
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    passage, term, count = key[edge] >> TERM_BITS, key[edge] & int(_MASK), np.diff(np.append(edge, len(key)))
    x = ((1 + np.log(count)) * idf[term]).astype(np.float32)
    z = np.add.reduceat(v[term] * x[:, None], np.flatnonzero(np.diff(passage, prepend=-1)))
    return z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)


def prepare(items: list[tuple[int, str]], idf: np.ndarray, v: np.ndarray) -> Items:
    ids, words, answers = [], [], []
    for i, text in items:
        h = blocks.hash_words(text or "")
        if len(h) < MIN_ITEM:
            continue
        sentences = [s for s in (blocks.hash_words(x) for x in (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split(".")) if len(s)]
        last = np.unique(sentences[-1])
        rare = last[idf[_terms(last)] >= np.median(idf[_terms(h)])]
        ids.append(i)
        words.append(h)
        answers.append(rare if len(rare) else last)
    if not ids:
        none = np.zeros(0, np.int64)
        return Items([], [], [], np.zeros((0, v.shape[1]), np.float32), none, none, np.zeros(0, np.uint64), np.zeros((1, 0), np.int16), none)
    count = np.array([len(h) for h in words])
    offsets = np.concatenate([[0], np.cumsum(count)])
    doc, first, size = windows(count, offsets[:-1], WINDOW, ITEM_STRIDE)
    vocabulary = np.unique(np.concatenate(words))
    has = np.zeros((len(vocabulary) + 1, len(ids)), np.uint8 if count.max() < 1 << 8 else np.int64)
    np.add.at(has, (np.searchsorted(vocabulary, np.concatenate(words)), np.repeat(np.arange(len(ids)), count)), 1)
    return Items(ids, words, answers, project(np.concatenate(words), first, size, idf, v), np.searchsorted(doc, np.arange(len(ids) + 1)), first - offsets[doc], vocabulary, has, np.ceil(LCS_MAYBE * count - 1e-9).astype(np.int64))


def lcs(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | (1 << k)
    full = (1 << len(item)) - 1
    s = full
    for x in region.tolist():
        if m := masks.get(x):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(item) - s.bit_count()


def slack_of(count: np.ndarray) -> np.ndarray:
    """Words on either side of an item of that many words which its region has besides."""
    return 4 + count // 8


def possible(word: np.ndarray, first: np.ndarray, size: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(segment, item) of all pairs that have LCS_MAYBE of the item's words in common, in whatever order."""
    none, known = np.zeros(0, np.int64), len(items.vocabulary)
    own = np.repeat(np.arange(len(first)), size)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    inside = word[at] < known
    key = np.sort(own[inside] * known + word[at[inside]])
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(edge):
        return none, none
    own, term, count = key[edge] // known, key[edge] % known, np.minimum(np.diff(np.append(edge, len(key))), np.iinfo(items.has.dtype).max).astype(items.has.dtype)
    start = np.flatnonzero(np.diff(own, prepend=-1))
    end, segments, out = np.append(start[1:], len(own)), own[start], []
    k = 0
    while k < len(start):
        last = max(k + 1, int(np.searchsorted(end, start[k] + 8192, side="right")))
        x = slice(start[k], end[last - 1])
        common = np.add.reduceat(np.minimum(items.has[term[x]], count[x, None]), start[k:last] - start[k], dtype=items.has.dtype)
        s, y = np.nonzero(common >= items.need)
        out.append((segments[k + s], y))
        k = last
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(w: blocks.Words, items: Items, idf: np.ndarray, v: np.ndarray) -> list[tuple[int, int, float, float, bool]]:
    """(document, item, cosine, share, answer) of verified leaks, the best region of each pair."""
    if not len(items.ids) or not len(w.hashes):
        return []
    word = np.searchsorted(items.vocabulary, w.hashes)
    word[items.vocabulary[np.minimum(word, len(items.vocabulary) - 1)] != w.hashes] = len(items.vocabulary)
    length = np.array([len(h) for h in items.words])
    slack = slack_of(length)
    # every region of every item lies within a segment
    reach = int((length + 2 * slack).max())
    doc, first, size = windows(np.diff(w.offsets), w.offsets[:-1], 2 * reach, reach)
    segment, item = possible(word, first, size, items)
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    seen: set[tuple[int, int, int]] = set()
    for s, y in zip(segment.tolist(), item.tolist(), strict=True):
        d, width, a, z = int(doc[s]), min(int(length[y]), WINDOW), int(first[s]), int(first[s] + size[s])
        lead, lo, hi = int(length[y]) - width, items.range_of[y], items.range_of[y + 1]
        # all places of the item of which a window of it lies in the segment, and their regions
        begins = np.arange(a - lead, max(a, z - width) + 1)
        left = np.maximum(w.offsets[d], begins - slack[y])
        right = np.minimum(w.offsets[d + 1], begins + length[y] + slack[y])
        base = int(left[0])
        run = np.concatenate([[0], np.cumsum(items.has[word[base : int(right[-1])], y] > 0)])
        enough = run[right - base] - run[left - base] >= items.need[y]
        if not enough.any():
            continue
        # windows from which one of these places is reached
        total = np.concatenate([[0], np.cumsum(enough)])
        at = a + np.flatnonzero(total[lead + 1 :] - total[: len(total) - lead - 1])
        cosine = project(w.hashes, at, np.minimum(width, z - at), idf, v) @ items.vectors[lo:hi].T
        i, j = np.nonzero(cosine >= MIN_COSINE)
        top = np.full(len(begins), -1.0)
        np.maximum.at(top, at[i] - items.start_of[lo + j] - begins[0], cosine[i, j])
        for k in np.flatnonzero(enough & (top >= 0)).tolist():
            known = best.get((d, y), (0, 0.0))[1]
            if known == 1 or (d, y, int(begins[k])) in seen:
                continue
            seen.add((d, y, int(begins[k])))
            region = w.hashes[left[k] : right[k]]
            share = lcs(items.words[y], region) / int(length[y])
            if share < LCS_MAYBE or share <= known:
                continue
            answer = bool(np.isin(items.answers[y], region).mean() >= ANSWER)
            if share >= LCS_SURE or answer:
                best[d, y] = (float(top[k]), share, answer)
    return [(d, k, *rest) for (d, k), rest in sorted(best.items())]


@dataclass(eq=False)
class Model:
    idf: np.ndarray
    v: np.ndarray
    sigma: np.ndarray
    items: Items


def models(documents: DataFrame, benchmark: DataFrame) -> list[Model]:
    """One model, or more if the items are too many to broadcast together."""
    text = blocks.narrow(documents, "text")
    df, n = count_passages(text)
    idf = idf_of(df, n)
    v, sigma = svd(text, idf)
    rows = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator()]
    parts, size = [[]], 0
    for row in rows:
        size += len(row[1] or "")
        if parts[-1] and (size > MAX_ITEMS_BYTES or len(parts[-1]) == MAX_ITEMS):
            parts.append([])
            size = len(row[1] or "")
        parts[-1].append(row)
    return [Model(idf, v, sigma, prepare(p, idf, v)) for p in parts]


SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, has_answer boolean"


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and leaked item: the cosine of the candidate, the share of the item
    found in order, and whether its answer is there."""
    out = None
    for model in models(documents, benchmark):
        known = documents.sparkSession.sparkContext.broadcast(model)

        def run(batches, known=known):
            m = known.value
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [(ids[a + d].as_py(), m.items.ids[k], *rest) for a, _, _, _, w in blocks.worded(batch.column("text")) for d, k, *rest in search(w, m.items, m.idf, m.v)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))], names=["doc_id", "item_id", "cosine", "lcs_share", "has_answer"])

        found = blocks.narrow(documents, "doc_id", "text").mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, with all their columns, in which no benchmark item is found."""
    for model in models(documents, benchmark):
        known = documents.sparkSession.sparkContext.broadcast(model)

        def run(batches, known=known):
            m = known.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, _, _, w in blocks.worded(batch.column("text")):
                    for d, *_ in search(w, m.items, m.idf, m.v):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
