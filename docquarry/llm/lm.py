"""Operator 7, LM scoring: unbounded n-grams from sharded suffix arrays of the corpus.

1. The corpus (all documents, whole) is cut into shards as the scan delivers it.  A shard's words are sorted by
   their contexts: a suffix array of the reversed text, built by prefix doubling.  A word that no scored text has can't
   be matched, so it ends a context like a document's edge does; and no context longer than the longest
   scored text is ever asked for, so sorting stops there.  Nothing else bounds the length of a match.
2. For every position of every scored text, a binary search narrows the interval of the suffix array
   word by word, backwards from that position, for as long as any occurrence is left.  That gives
   the counts of all contexts up to the longest in this shard.
3. Counts are summed over shards.  The longest matching context of a position is the longest of positive sum.
4. The probability of word w after its context is smoothed from the empty context up to
   the longest one: P(w | n words) = (count(n words, w) + KAPPA * P(w | n - 1 words)) / (count(n words) + KAPPA),
   P(w) = (count(w) + KAPPA / NOMINAL_WORDS) / (words of the corpus + KAPPA).

One pass over the corpus serves all texts scored, as long as these hold at most BLOCK_BYTES; more texts are
scored in several passes of that size each.  What is shuffled is counts, per shard and position.

Defined results: a text that is null or has no word has words 0 and null scores; repeated rows are scored each; null
corpus texts are empty; over a corpus without a word, all words have probability 1 / NOMINAL_WORDS and no context matches.  Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import blocks

KAPPA = 2.0
NOMINAL_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
COUNTS = "at long, len int, n long"


def _follow(text: np.ndarray, at: np.ndarray, take: int, bits: int) -> np.ndarray:
    """Packs take words, from each place backwards; words after an end (0) count as 0."""
    key = np.zeros(len(at), np.uint64)
    alive = np.ones(len(at), bool)
    for k in range(take):
        w = np.where(alive, text[np.maximum(at - k, 0)], 0)
        alive &= w > 0
        key = (key << np.uint64(bits)) | w.astype(np.uint64)
    return key


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text (ids, 0 an end, text[0] an end) that hold a word, ordered by the words read backwards from them.

    Suffixes that agree on at least depth words are in any order.
    """
    at = np.flatnonzero(text)
    if not len(at):
        return at
    bits = max(1, int(text.max()).bit_length())
    h = 64 // bits
    key = _follow(text, at, h, bits)
    order = np.argsort(key, kind="stable")
    sa, key = at[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(np.append(first, len(sa)))) + 1
    rank = np.zeros(len(text), np.int64)
    rank[sa] = group
    last_word = np.uint64((1 << bits) - 1)
    # a suffix that has ended equals its group in all that it has
    open_ = (key & last_word) > 0
    while h < depth:
        size = np.bincount(group, minlength=len(sa) + 2)
        tied = np.flatnonzero(open_ & (size[group] > 1))
        if not len(tied):
            break
        mine = sa[tied]
        nxt = rank[np.maximum(mine - h, 0)]
        o = np.lexsort((nxt, group[tied]))
        sa[tied], nxt, g = mine[o], nxt[o], group[tied]
        starts = np.append(True, (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1]))
        # tied holds whole groups, so a new group's rank is its first slot
        lead = tied[np.flatnonzero(starts)]
        group[tied] = np.repeat(lead, np.diff(np.append(np.flatnonzero(starts), len(tied)))) + 1
        open_[tied] = nxt > 0
        rank[sa[tied]] = group[tied]
        h *= 2
    return sa


def _bound(text, sa, depth, lo, hi, want, right: bool) -> np.ndarray:
    """Binary search of each interval for the first slot whose word at that depth is not less (or is more) than wanted."""
    lo, hi = lo.copy(), hi.copy()
    while (busy := lo < hi).any():
        mid = (lo + hi) >> 1
        w = text[sa[np.minimum(mid, len(sa) - 1)] - depth]
        up = busy & ((w <= want) if right else (w < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(busy & ~up, mid, hi)
    return lo


def counts(text: np.ndarray, sa: np.ndarray, asked: np.ndarray):
    """(place in asked, length, count) of all contexts that occur, by length; asked holds ids and ends (0)."""
    at = np.flatnonzero(asked)
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    depth = 0
    while len(at):
        want = asked[at - depth]
        here = want > 0
        at, lo, hi, want = at[here], lo[here], hi[here], want[here]
        lo, hi = _bound(text, sa, depth, lo, hi, want, False), _bound(text, sa, depth, lo, hi, want, True)
        found = hi > lo
        at, lo, hi = at[found], lo[found], hi[found]
        depth += 1
        if len(at):
            yield at, depth, hi - lo


def _ids(w: blocks.Words, vocabulary: np.ndarray) -> np.ndarray:
    """Ids of words by place in vocabulary, 1 and up; 0 for other words, and before each document and at the end."""
    slot = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
    ids = np.where(vocabulary[slot] == w.hashes, slot + 1, 0) if len(vocabulary) else np.zeros(len(w.hashes), np.int64)
    docs = len(w.offsets) - 1
    out = np.zeros(len(ids) + docs + 1, np.int32)
    out[np.arange(len(ids)) + w.doc_of() + 1] = ids
    return out


def corpus_counts(corpus: DataFrame, vocabulary: np.ndarray, asked: np.ndarray, depth: int) -> DataFrame:
    """COUNTS over the whole corpus; at -1 has the number of its words."""
    shared = corpus.sparkSession.sparkContext.broadcast((vocabulary, asked))

    def run(batches):
        vocabulary, asked = shared.value
        for batch in batches:
            parts, total = [], 0
            for _, _, _, _, w in blocks.worded(batch.column("text")):
                parts.append(_ids(w, vocabulary))
                total += len(w.hashes)
            out = [(np.array([-1]), 0, np.array([total]))]
            if parts:
                text = np.concatenate(parts)
                out += counts(text, suffix_array(text, depth), asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a for a, _, _ in out]), pa.int64()), pa.array(np.repeat([d for _, d, _ in out], [len(a) for a, _, _ in out]), pa.int32()), pa.array(np.concatenate([n for _, _, n in out]), pa.int64())],
                names=["at", "len", "n"],
            )

    return corpus.select("text").mapInArrow(run, COUNTS).groupBy("at", "len").agg(F.sum("n").alias("n"))


def _score(rows: pa.Table, corpus: DataFrame) -> DataFrame:
    """Scores of the rows (id, text) of one block."""
    spark = corpus.sparkSession
    parts = [(w.hashes, np.diff(w.offsets)) for *_, w in blocks.worded(rows.column("text"))]
    hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
    size = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
    vocabulary = np.unique(hashes)
    asked = _ids(blocks.Words(hashes, hashes, hashes, np.concatenate([[0], np.cumsum(size)])), vocabulary)
    # row r's words lie from its start on; the place before them is an end
    start = np.cumsum(size) - size + np.arange(len(size)) + 1
    texts = spark.createDataFrame(pa.table({"id": rows.column("id"), "row": pa.array(np.arange(len(size)), pa.int64()), "start": pa.array(start, pa.int64()), "words": pa.array(size, pa.int64())}))
    found = blocks.written(corpus_counts(corpus, vocabulary, asked, int(size.max()) + 1 if len(size) else 1), "counts")
    total = (found.where("at = -1").agg(F.sum("n")).first()[0] or 0) + KAPPA
    by_len = found.where("at >= 0").groupBy("at").agg(F.expr("transform(array_sort(collect_list(struct(len, n))), x -> x.n)").alias("ns"))
    words = texts.where("words > 0").select("row", F.explode(F.expr("sequence(start, start + words - 1)")).alias("at"), "start")
    # a context ends one place before its word; before a text's first word there is none
    words = words.join(by_len, "at", "left").join(by_len.select((F.col("at") + 1).alias("at"), F.col("ns").alias("before")), "at", "left")
    words = words.withColumns({"ns": F.coalesce("ns", F.array().cast("array<bigint>")), "before": F.coalesce("before", F.array().cast("array<bigint>"))})
    p0 = f"(cast(coalesce(get(ns, 0), 0) as double) + {KAPPA / NOMINAL_WORDS!r}D) / {total!r}D"
    p = F.expr(f"aggregate(before, struct({p0} as p, 1 as n), (s, c) -> struct((cast(coalesce(get(ns, s.n), 0) as double) + {KAPPA!r}D * s.p) / (c + {KAPPA!r}D) as p, s.n + 1 as n)).p")
    per = words.select("row", F.log2(p).alias("bits"), F.size("before").alias("context")).groupBy("row").agg(F.avg("bits").alias("mean_log2"), F.avg("context").alias("mean_context"), F.max("context").alias("longest_context"))
    return texts.join(per, "row", "left").select("id", "words", "mean_log2", F.pow(F.lit(2.0), -F.col("mean_log2")).alias("perplexity"), "mean_context", "longest_context")


def score(texts: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words, mean_log2, perplexity, mean_context, longest_context), a row per row of texts."""
    t = texts.select(F.col(key).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    held = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-held // BLOCK_BYTES) or 1
    out = None
    for k in range(n):
        rows = t.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow()
        part = _score(rows, corpus)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts, scored by the n-grams of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"), "item_id")
