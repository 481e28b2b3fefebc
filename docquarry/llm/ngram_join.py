"""Operator 2, n-gram Jaccard join with token-combination prefixes.

A document is the set of its word N-grams (tokens).  The join finds all pairs of documents
of Jaccard similarity THRESHOLD or more, exactly (up to collisions of 64-bit set hashes, of 48-bit signatures, and of
token hashes, of 32 bits and the shard's number), and reports them by document: its class and its links.

1. One pass over the corpus cuts texts into token sets.  Tokens go to shards, which count each in all
   documents.  A token that occurs in several documents of a task goes there once, with their number,
   so a shard never holds more of it than there are tasks.
2. Shards answer with the tokens that more than one document has, and their level, rising with frequency.
   All other tokens can't be shared: they come first in the global order, by level, then hash.  A document
   whose prefix has such tokens only is similar to none and goes no further.  Copies, documents of one token
   set, are collapsed to the set.
3. Tokens are of class 1 or, if more than CLASS_SHARE[k - 2] of the documents have them, class k.
   A set's prefix in the global order is extended until no set that reaches the threshold can avoid
   all its signatures: the single tokens of class 1, and for class k the combinations of k tokens of the same hash
   group.  Destroying all those of c tokens of a group takes c - k + 1 absent tokens, so the
   prefix is the shortest one whose sum of these exceeds the number of tokens that a similar set
   may lack.  There are a set's size / GROUP groups, rounded down to a power of two, and again twice as many (so that
   similar sets of different sizes have a grouping in common); so signatures grow as the tokens and not
   as their k-th power.  Sets with too few tokens for that coverage are indexed by all their combinations and
   single tokens.
4. Signatures are shuffled as packed arrays.  Sets that share one and pass the length filter are candidates.
   A set travels with its HEAD lowest signatures: of the shards where a pair meets, only that of the lowest
   signature that both heads have gives it out (all do if there is none; repeats are dropped afterwards).
   A signature of more than HOT sets is split by blocks of sets, and by pairs of blocks.
5. Candidates are verified on their shared tokens, gathered per neighbourhood, so that a set travels once to each
   group of candidates and not once for each pair; neighbourhoods of more than MEMBERS sets are split the same way.
   Each gives its sets' numbers of links and a spanning forest; no pair of sets leaves it.
6. Large groups of near copies share many signatures, so their pairs aren't enumerated by signature: sets connected by
   signatures of CROWD sets and more are a crowd if its pairs are no more than those of these signatures.  The pairs
   within a crowd leave step 4; shared tokens of all of them are counted by products of blocks of MEMBERS sets by tokens.
7. Classes are the connected components of these forests.

There is no cap on partners, and no step whose cost is bounded by dropping any.

Defined results: null and empty texts have no token: they are a class of their own, without links; a text of fewer
than N words has one token, all its words; rows of a null doc_id are left out; rows of one doc_id that
repeat count as copies or near copies of each other, if they are; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import blocks

N = 3
THRESHOLD = 0.55
#: A token is of class k + 1 if more than that share of the documents have it.
CLASS_SHARE = (0.01, 0.05)
GROUP = 12
HEAD = 8
HOT = 1 << 16
MEMBERS = 1024
CROWD = 128
#: Tokens that a task holds before it sends them.
FLUSH = 1 << 22
#: Tokens that it sorts at once, about.
PIECE = 1 << 18
#: So many dropped documents' ids, 8 bytes each, are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_SEVERAL = 0xFFFF
_PAD = np.uint64(0xFFFFFFFFFFFF)


def token_sets(column: pa.Array, n: int):
    """Per slice: first document, sorted distinct tokens, offsets of documents, their set ids."""
    for a, _, _, _, w in blocks.worded(column):
        h, o = blocks.shingles(w, n)
        doc = np.repeat(np.arange(len(o) - 1), np.diff(o))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
        h, doc = h[new], doc[new]
        at = np.searchsorted(doc, np.arange(len(o)))
        ids = np.zeros(len(o) - 1, np.uint64)
        full = np.diff(at) > 0
        if full.any():
            with np.errstate(over="ignore"):
                ids[full] = blocks.mix(np.add.reduceat(blocks.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full]))
        yield a, h, at, ids


def lacking(size: np.ndarray, t: float) -> np.ndarray:
    """Most tokens of a set of that size that a set of similarity t or more may lack."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64)


def level_of(count):
    """Quarter powers of two: 4 and up for tokens that two documents or more have."""
    return np.floor(4 * np.log2(count) + 1e-9).astype(np.uint8)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _planes(v: np.ndarray) -> np.ndarray:
    """Numbers as their lowest bytes, the next bytes, and so on: the high ones compress."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T)


def _unplanes(data, count: int, kind, at: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, count * width, at).reshape(width, count).T).view(kind)[:, 0]


def _steps(v: np.ndarray) -> np.ndarray:
    """Sorted numbers by the planes of their differences."""
    return _planes(np.diff(v, prepend=v.dtype.type(0)))


def _unsteps(data, count: int, kind, at: int = 0) -> np.ndarray:
    return np.cumsum(_unplanes(data, count, kind, at), dtype=kind)


def _six(v: np.ndarray) -> np.ndarray:
    """The lower six bytes of 64-bit numbers."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), 8)[:, :6])


def _unsix(data, count: int, at: int = 0) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * count, at).reshape(count, 6)
    return wide.view(np.uint64)[:, 0]


_EXCHANGE = "key long, home long, kind int, n int, data binary"
_ASKED, _KEPT, _SHARED = range(3)


def _exchange(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "home", "kind", "n", "data"])


def _cut(n: int, shards: int, flush: int):
    """Per task: tokens for the shards, and what the task keeps for the answers, as rows of _EXCHANGE.

    A home is what a task read between two sendings; its number and its documents' places in it are the same
    whenever the task is repeated, since a scan repeats its order.
    """

    def send(home: int, parts):
        """Some shards at a time, so that neither the sorted tokens nor a batch are as large as what the task read."""
        doc_ids, ids, size = (np.concatenate([x[j] for x in parts]) for j in range(3))
        tokens, docs, base = [x[3] for x in parts], [], 0
        for x in parts:
            docs.append(np.repeat(np.arange(base, base + len(x[2])).astype(np.uint16), x[2]))
            base += len(x[2])
        shard_of = lambda h: ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        pieces = min(shards, -(-int(size.sum()) // PIECE), 0xFFFF)
        piece = [(shard_of(h) * np.uint64(pieces) // np.uint64(shards)).astype(np.uint16) for h in tokens]
        kept: list[tuple] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16))]
        for r in range(pieces):
            pick = [np.flatnonzero(x == r) for x in piece]
            h, doc = (np.concatenate([x[at] for x, at in zip(column, pick, strict=True)]) for column in (tokens, docs))
            key = (shard_of(h) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            count = np.diff(np.append(first, len(key))).astype(np.uint32)
            several = count > 1
            mine, place = key[first], np.where(several, _SEVERAL, doc[first] if len(first) else 0).astype(np.uint16)
            kept.append((mine[several], count[several], doc[np.repeat(several, count)]))
            edge = np.searchsorted(mine >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
            low, rows = mine.astype(np.uint32), []
            for s in np.flatnonzero(np.diff(edge)).tolist():
                x = slice(edge[s], edge[s + 1])
                rows.append((s, home, _ASKED, edge[s + 1] - edge[s], _pack(_steps(low[x]), place[x], _planes(count[x]))))
            yield _exchange(rows)
        mine, count, held = (np.concatenate(x) for x in zip(*kept, strict=True))
        yield _exchange([(-1 - home % shards, home, _KEPT, len(size), _pack(doc_ids, ids, size, np.array([len(mine), len(held)], np.int64), _steps(mine), _planes(count), held))])

    def run(batches):
        home, held, parts, docs = blocks.partition_id() << 24, 0, [], 0
        for batch in batches:
            doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, h, at, ids in token_sets(batch.column("text"), n):
                for x in range(0, len(ids), _SEVERAL - 1):  # a place in the home has 16 bits
                    y = min(len(ids), x + _SEVERAL - 1)
                    if parts and (held + at[y] - at[x] > flush or docs + y - x >= _SEVERAL):
                        yield from send(home, parts)
                        home, held, parts, docs = home + 1, 0, [], 0
                    parts.append((doc_id[a + x : a + y], ids[x:y], np.diff(at[x : y + 1]), h[at[x] : at[y]]))
                    held, docs = held + int(at[y] - at[x]), docs + y - x
        if parts:
            yield from send(home, parts)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each home the tokens of this shard that more than one document has, with their levels."""
    kind = table.column("kind")[0].as_py()
    if kind == _KEPT:
        return table
    homes, sizes = table.column("home").to_pylist(), table.column("n").to_pylist()
    v, place, count = [], [], []
    for x, k in zip(table.column("data"), sizes, strict=True):
        x = x.as_buffer()
        v.append(_unsteps(x, k, np.uint32))
        place.append(np.frombuffer(x, np.uint16, k, 4 * k))
        count.append(_unplanes(x, k, np.uint32, 6 * k))
    every, n = np.concatenate(v), np.concatenate(count).astype(np.int64)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1])[: len(every)])
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(every))))
    shard, rows, at = table.column("key")[0].as_py(), [], 0
    for home, own, where in zip(homes, v, place, strict=True):
        all_ = total[at : at + len(own)]
        at += len(own)
        take = all_ > 1
        rows.append((shard, home, _SHARED, int(take.sum()), _pack(_steps(own[take]), where[take], level_of(all_[take]))))
    return pa.Table.from_batches([_exchange(rows)])


_SETS = "doc_id long, id long, size int, tokens binary, levels binary"


def _choose(t: float):
    """The documents of a home; those that may have a partner with their shared tokens, in the global order."""

    def run(table: pa.Table) -> pa.Table:
        token, level, doc = [], [], []
        several = at = None
        for key, kind, k, x in zip(table.column("key").to_pylist(), table.column("kind").to_pylist(), table.column("n").to_pylist(), table.column("data"), strict=True):
            x = x.as_buffer()
            if kind == _SHARED:
                token.append(_unsteps(x, k, np.uint32) | np.uint64(key << 32))
                doc.append(np.frombuffer(x, np.uint16, k, 4 * k))
                level.append(np.frombuffer(x, np.uint8, k, 6 * k))
                continue
            doc_id, ids, size = (np.frombuffer(x, np.int64, k, 8 * k * j) for j in range(3))
            m, held = np.frombuffer(x, np.int64, 2, 24 * k)
            several = _unsteps(x, m, np.uint64, 24 * k + 16)
            at = np.concatenate([[0], np.cumsum(_unplanes(x, m, np.uint32, 24 * k + 16 + 8 * m))]).astype(np.int64)
            places = np.frombuffer(x, np.uint16, held, 24 * k + 16 + 12 * m)
        token, level, doc = (np.concatenate(c) if c else np.zeros(0, kind) for c, kind in ((token, np.uint64), (level, np.uint8), (doc, np.uint16)))
        many = doc == _SEVERAL
        slot = np.searchsorted(several, token[many])
        n = at[slot + 1] - at[slot]
        spread = np.repeat(at[slot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        token, level, doc = (np.concatenate(c) for c in ((token[~many], np.repeat(token[many], n)), (level[~many], np.repeat(level[many], n)), (doc[~many], places[spread])))
        order = np.lexsort((token, level, doc))
        # of a shard's number the lower 16 bits are kept
        token, level, doc = _six(token[order]), level[order], doc[order]
        edge = np.searchsorted(doc, np.arange(len(size) + 1))
        active = size - np.diff(edge) <= lacking(size, t)
        active &= size > 0
        some = [(token[edge[d] : edge[d + 1]].tobytes(), level[edge[d] : edge[d + 1]].tobytes()) if active[d] else (None, None) for d in range(len(size))]
        return pa.table({"doc_id": doc_id, "id": pa.array(ids, mask=size == 0), "size": size.astype(np.int32), "tokens": pa.array([x for x, _ in some], pa.binary()), "levels": pa.array([x for _, x in some], pa.binary())})

    return run


def sets_of(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(doc_id, id, size, tokens, levels) of all documents; id, the set's, is null without tokens; tokens and
    levels hold the tokens that other documents have too, and are null if no document can be similar."""
    shards = 2 * _partitions(docs.sparkSession)
    asked = docs.mapInArrow(_cut(n, shards, FLUSH), _EXCHANGE)
    return asked.groupBy("key").applyInArrow(_answer, _EXCHANGE).groupBy("home").applyInArrow(_choose(t), _SETS)


def combine(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-token combinations (k is 2 or 3)."""
    tokens = np.sort(tokens)
    a, b = np.triu_indices(len(tokens), 1)
    with np.errstate(over="ignore"):
        pair = blocks.mix(tokens[a] * np.uint64(3) + tokens[b] * np.uint64(5) + np.uint64(2))
        if k == 2:
            return pair
        rest = len(tokens) - 1 - b
        third = np.repeat(b + 1 - np.concatenate([[0], np.cumsum(rest)[:-1]]), rest) + np.arange(int(rest.sum()))
        return blocks.mix(np.repeat(pair, rest) * np.uint64(7) + tokens[third])


def extended(tokens: np.ndarray, classes: np.ndarray, size: int, need: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, and for each the place of its first token in the order.

    tokens are its shared tokens in the global order; need is how many of the set's tokens, less those not shared,
    must be absent from a set that avoids all signatures.
    """
    single = int(np.searchsorted(classes, 2))
    if single >= need:
        return tokens[:need], np.arange(need)
    sigs, places, short = [tokens[:single]], [np.arange(single)], False
    rest, cls = tokens[single:], classes[single:].astype(np.int64)
    groups = 1 << max(0, int(np.floor(np.log2(size / GROUP))))
    mixed = blocks.mix(rest)
    for _ in range(int(np.ceil(-np.log2(t))) + 1):
        cell = (mixed & np.uint64(groups - 1)).astype(np.int64) * 8 + cls
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0)[: len(order)])
        within = np.empty(len(rest), np.int64)
        within[order] = np.arange(len(rest)) - np.repeat(first, np.diff(np.append(first, len(rest))))
        reached = np.cumsum(within >= cls - 1)
        p = int(np.searchsorted(reached, need - single)) + 1
        short |= p > len(rest)
        for c in np.unique(cell[:p]).tolist():
            at = np.flatnonzero(cell[:p] == c)
            if len(at) >= c % 8:
                sigs.append(combine(rest[at], c % 8))
                places.append(np.full(len(sigs[-1]), single + at[0]))
        groups *= 2
    if short:
        sigs.append(rest)
        places.append(single + np.arange(len(rest)))
    sig, where = np.unique(np.concatenate(sigs), return_index=True)
    return sig, np.concatenate(places)[where]


def signatures(size: np.ndarray, tokens: np.ndarray, levels: np.ndarray, at: np.ndarray, bounds: list[int], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, level) of sets given by the offsets of their shared tokens; bounds: the highest level of each class."""
    classes = 1 + np.searchsorted(np.array(bounds, np.uint8), levels, side="left")
    need = lacking(size, t) + 1 - (size - np.diff(at))
    doc = np.repeat(np.arange(len(size)), np.diff(at))
    inside = np.arange(len(tokens)) - at[doc] < need[doc]
    special = np.zeros(len(size), bool)
    special[doc[inside & (classes > 1)]] = True
    plain = inside & ~special[doc]
    docs, sigs, level = [doc[plain]], [tokens[plain]], [levels[plain]]
    for d in np.flatnonzero(special).tolist():
        x = slice(at[d], at[d + 1])
        s, place = extended(tokens[x], classes[x], int(size[d]), int(need[d]), t)
        docs.append(np.full(len(s), d))
        sigs.append(s)
        level.append(levels[x][place])
    return np.concatenate(docs), np.concatenate(sigs), np.concatenate(level)


def split_hot(doc: np.ndarray, sig: np.ndarray, level: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature), a signature that more than most sets may have replaced by those of its pairs of blocks."""
    hot = level > level_of(most)
    if not hot.any():
        return doc, sig
    docs, sigs = [doc[~hot]], [sig[~hot]]
    for x in np.unique(level[hot]).tolist():
        own = hot & (level == x)
        n = int(np.ceil(2 ** ((x + 1) / 4) / most))
        block = (blocks.mix(ids[doc[own]]) % np.uint64(n)).astype(np.int64)
        for other in range(n):
            low, high = np.minimum(block, other).astype(np.uint64), np.maximum(block, other).astype(np.uint64)
            docs.append(doc[own])
            with np.errstate(over="ignore"):
                sigs.append(blocks.mix(sig[own] + (low * np.uint64(n) + high + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(docs), np.concatenate(sigs)


def _columns(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _signed(batch, bounds: list[int], t: float) -> tuple[np.ndarray, ...]:
    """Ids and sizes of a batch of sets, and (set, signature, level) of these."""
    ids, size = _columns(batch, "id", "size")
    ids, size = ids.view(np.uint64), size.astype(np.int64)
    tokens = [_unsix(x.as_buffer(), len(x.as_buffer()) // 6) for x in batch.column("tokens")]
    at = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int64)
    levels = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("levels")])
    return ids, size, *signatures(size, np.concatenate(tokens), levels, at, bounds, t)


def _bounds(documents: int) -> list[int]:
    return [int(level_of(max(8, share * documents))) for share in CLASS_SHARE]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For places 0 to n - 1 the lowest place that each is connected with by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def crowds(active: DataFrame, documents: int, t: float, shards: int) -> DataFrame:
    """(id, crowd, n) of the sets in crowds, n being a crowd's number of sets."""
    bounds, most = _bounds(documents), CROWD

    def hot(batches):
        for batch in batches:
            if batch.num_rows:
                ids, _, doc, sig, level = _signed(batch, bounds, t)
                some = level >= level_of(most)
                sig = sig[some] & np.uint64((1 << 48) - 1)
                yield pa.RecordBatch.from_arrays([pa.array((sig % np.uint64(shards)).astype(np.int32)), pa.array(sig.view(np.int64)), pa.array(ids[doc[some]].view(np.int64))], names=["shard", "sig", "id"])

    def forest(table: pa.Table) -> pa.Table:
        sig, ids = _columns(table, "sig", "id")
        known, own = np.unique(ids, return_inverse=True)
        order = np.argsort(sig, kind="stable")
        sig, own = sig[order], own[order]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        run = np.diff(np.append(first, len(sig)))
        big = run >= most
        own, head = own[np.repeat(big, run)], np.repeat(own[first[big]], run[big])
        root, some = roots(len(known), own, head), np.unique(own)
        cost = np.bincount(root[own[np.cumsum(run[big]) - 1]], run[big].astype(float) ** 2, len(known))
        return pa.table({"id": known[some], "root": known[root[some]], "cost": cost[some]})

    trees = blocks.written(active.mapInArrow(hot, "shard int, sig long, id long").groupBy("shard").applyInArrow(forest, "id long, root long, cost double"), "trees")
    known = components(trees.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "crowd")
    known = blocks.written(known.where("crowd <> 0"), "known")  # 0 is for sets in none
    worth = trees.groupBy("id").agg(F.sum("cost").alias("cost")).join(known, "id").groupBy("crowd").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    return blocks.written(known.join(worth.where("double(n) * n <= cost").select("crowd", "n"), "crowd").select("id", "crowd", "n"), "crowds")


def index_sets(active: DataFrame, documents: int, t: float, shards: int) -> DataFrame:
    """Packed sets (id, size, crowd or 0, head) and their signatures, by shard."""
    bounds, most = _bounds(documents), HOT

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size, doc, sig, level = _signed(batch, bounds, t)
            crowd = batch.column("crowd").to_numpy(zero_copy_only=False)
            doc, sig = split_hot(doc, sig, level, ids, most)
            sig &= np.uint64((1 << 48) - 1)
            order = np.lexsort((sig, doc))
            doc, sig = doc[order], sig[order]
            begin = np.searchsorted(doc, np.arange(len(ids)))
            head = np.full((len(ids), HEAD), _PAD)
            rank = np.arange(len(doc)) - begin[doc]
            low = rank < HEAD
            head[doc[low], rank[low]] = sig[low]
            shard = (sig % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            doc, sig, edge = doc[order], sig[order], np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(edge)).tolist():
                own, place = np.unique(doc[edge[s] : edge[s + 1]], return_inverse=True)
                rows.append((s, len(own), _pack(ids[own], crowd[own], size[own].astype(np.uint32), _six(head[own].ravel()), _six(sig[edge[s] : edge[s + 1]]), _planes(place.astype(np.uint32)))))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["shard", "n", "data"])

    return active.mapInArrow(run, "shard int, n int, data binary")


def pairs_of(sig: np.ndarray, own: np.ndarray, size: np.ndarray, crowd: np.ndarray, t: float, most: int = 1 << 21):
    """Pairs of places (a < b, as a << 32 | b) that share a signature, not a crowd, and pass the length filter, distinct within a batch."""
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
    run = np.diff(np.append(first, len(sig)))
    if len(sig):
        within = crowd[own]
        low = np.minimum.reduceat(within, first)
        others = np.repeat((low == 0) | (low != np.maximum.reduceat(within, first)), run)
        sig, own = sig[others], own[others]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        run = np.diff(np.append(first, len(sig)))
    # each element pairs with those after it in its run
    after = np.repeat(first + run, run) - np.arange(len(sig)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    held, count, x = [], 0, 0
    while x < len(sig):
        y = max(x + 1, int(np.searchsorted(total, total[x] + most, side="right")) - 1)
        n = after[x:y]
        left = np.repeat(np.arange(x, y), n)
        a, b = own[left], own[left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)]
        ok = (np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9) & ((crowd[a] != crowd[b]) | (crowd[a] == 0))
        held.append(np.unique(a[ok] << 32 | b[ok]))
        count += len(held[-1])
        if count > most:
            held = [np.unique(np.concatenate(held))]
            count = len(held[0])
            if count > most:
                yield held[0]
                held, count = [], 0
        x = y
    if count:
        yield np.unique(np.concatenate(held))


def candidates(index: DataFrame, t: float, shards: int) -> DataFrame:
    """Pairs of set ids that share a signature, each once, but those within a crowd."""

    def meet(table: pa.Table) -> pa.Table:
        shard, ids, crowd, size, heads, sig, own, k = np.uint64(table.column("shard")[0].as_py()), [], [], [], [], [], [], 0
        for n, x in zip(table.column("n").to_pylist(), table.column("data"), strict=True):
            x = x.as_buffer()
            base = n * (20 + 6 * HEAD)
            m = (len(x) - base) // 10
            ids.append(np.frombuffer(x, np.int64, n))
            crowd.append(np.frombuffer(x, np.int64, n, 8 * n))
            size.append(np.frombuffer(x, np.uint32, n, 16 * n).astype(np.int64))
            heads.append(_unsix(x, n * HEAD, 20 * n).reshape(n, HEAD))
            sig.append(_unsix(x, m, base))
            own.append(_unplanes(x, m, np.uint32, base + 6 * m).astype(np.int64) + k)
            k += n
        ids, crowd, size, heads = (np.concatenate(x) for x in (ids, crowd, size, heads))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for pair in pairs_of(np.concatenate(sig), np.concatenate(own), size, crowd, t):
            for x in range(0, len(pair), 1 << 15):
                a, b = pair[x : x + (1 << 15)] >> 32, pair[x : x + (1 << 15)] & 0xFFFFFFFF
                common = (heads[a][:, :, None] == heads[b][:, None, :]).any(2) & (heads[a] != _PAD)
                lowest = heads[a, common.argmax(1)]
                mine = ~common.any(1) | (lowest % np.uint64(shards) == shard)
                left.append(ids[a[mine]])
                right.append(ids[b[mine]])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return index.groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


def verify(active: DataFrame, pairs: DataFrame, t: float, each: bool = False) -> DataFrame:
    """(id, links, root) of sets in verified pairs, per neighbourhood: how many documents of other sets are similar
    to the set, and the lowest set that it is connected with there.  With each, the pairs (a, b, jaccard) instead."""
    spark = active.sparkSession
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    home = blocks.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("home")), "homes")
    blocks_of = home.groupBy("home").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    homes = home.join(blocks_of, "home").select("a", "home", "parts")
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    placed = pairs.join(homes, "a").select("a", "b", F.pmod(F.xxhash64("home", F.least(part("a"), part("b")), F.greatest(part("a"), part("b"))), F.lit(_partitions(spark) * 64)).alias("place"))
    placed = blocks.written(placed, "placed")
    members = placed.select(F.col("place").alias("spot"), F.col("a").alias("id")).unionByName(placed.select(F.col("place").alias("spot"), F.col("b").alias("id"))).distinct()
    sets = members.join(active.select("id", "size", "copies", "tokens"), "id").select("spot", "id", "size", "copies", "tokens")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, size, copies = _columns(right, "id", "size", "copies")
        order = np.argsort(ids)
        tokens = [np.sort(_unsix(x.as_buffer(), len(x.as_buffer()) // 6)) for x in right.column("tokens")]
        a, b = (order[np.searchsorted(ids, c, sorter=order)] for c in _columns(left, "a", "b"))
        same = np.array([_shared(tokens[x], tokens[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        score = same / (size[a] + size[b] - same)
        good = score >= t - 1e-9
        return _found(ids, copies, a[good], b[good], score[good], each)

    return placed.groupBy("place").cogroup(sets.groupBy("spot")).applyInArrow(meet, _PAIRS if each else _LINKS)


_PAIRS, _LINKS = "a long, b long, jaccard double", "id long, links long, root long"


def _found(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray, each: bool) -> pa.Table:
    """What verified pairs of places (a, b) are as rows of _PAIRS or _LINKS."""
    if each:
        return pa.table({"a": ids[a], "b": ids[b], "jaccard": score})
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = ids[order][roots(len(ids), place[a], place[b])][place]
    some = links > 0
    return pa.table({"id": ids[some], "links": links[some], "root": root[some]})


def shared_counts(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each of the sets left has in common with each of right (places in tokens).

    Tokens of few pairs are counted pair by pair, the others by products of 0/1 matrices, some tokens at a time.
    """
    _, token = np.unique(np.concatenate(tokens), return_inverse=True)
    token = np.split(token, np.cumsum([len(x) for x in tokens])[:-1])
    kinds = 1 + max((int(x.max()) for x in token if len(x)), default=0)
    total, sides = np.zeros((len(left), len(right)), np.int32), []
    for some in (left, right):
        column, row = np.concatenate([token[k] for k in some]), np.repeat(np.arange(len(some)), [len(token[k]) for k in some])
        order = np.argsort(column, kind="stable")
        sides.append((column[order], row[order], np.bincount(column, minlength=kinds)))
    (u, i, m), (v, j, n) = sides
    pairs = m * n
    rare = (pairs > 0) & (pairs * 100 <= total.size)
    low, first = rare[u], np.cumsum(n) - n
    u_low, i_low = u[low], i[low]
    reach = np.concatenate([[0], np.cumsum(n[u_low])])
    x = 0
    while x < len(u_low):
        y = max(x + 1, int(np.searchsorted(reach, reach[x] + (1 << 20), side="right")) - 1)
        k = n[u_low[x:y]]
        other = j[np.repeat(first[u_low[x:y]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        total += np.bincount(np.repeat(i_low[x:y], k) * len(right) + other, minlength=total.size).reshape(total.shape).astype(np.int32)
        x = y
    dense = np.flatnonzero((pairs > 0) & ~rare)
    for at in range(0, len(dense), 1024):
        own = dense[at : at + 1024]
        place = np.full(kinds, -1)
        place[own] = np.arange(len(own))
        matrices = []
        for column, row, count in ((u, i, len(left)), (v, j, len(right))):
            has = place[column]
            x = np.zeros((count, len(own)), np.float32)
            x[row[has >= 0], has[has >= 0]] = 1
            matrices.append(x)
        total += (matrices[0] @ matrices[1].T).astype(np.int32)
    return total


def verify_crowds(active: DataFrame, crowd: DataFrame, t: float, each: bool = False) -> DataFrame:
    """What verify gives, of all pairs of sets within crowds."""
    part = crowd.select("id", "crowd", F.ceil(F.col("n") / MEMBERS).cast("long").alias("parts")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    spots = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("id", "crowd", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    sets = spots.join(active.select("id", "size", "copies", "tokens"), "id")

    def meet(table: pa.Table) -> pa.Table:
        ids, size, copies, part = _columns(table, "id", "size", "copies", "part")
        tokens = [_unsix(x.as_buffer(), len(x.as_buffer()) // 6) for x in table.column("tokens")]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        if not len(left) or not len(right):
            none = np.zeros(0, np.int64)
            return _found(ids, copies, none, none, np.zeros(0), each)
        same = shared_counts(tokens, left, right).astype(np.int64)
        score = same / (size[left][:, None] + size[right][None, :] - same)
        good = score >= t - 1e-9
        if low == high:
            good = np.triu(good, 1)
        a, b = np.nonzero(good)
        return _found(ids, copies, left[a], right[b], score[good], each)

    return sets.groupBy("crowd", "low", "high").applyInArrow(meet, _PAIRS if each else _LINKS)


def _shared(u: np.ndarray, v: np.ndarray) -> int:
    if len(u) > len(v):
        u, v = v, u
    return int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()) if len(u) else 0


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _prepared(documents: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All documents' sets, the distinct ones that may have a partner, their crowds, and candidate pairs of these."""
    spark = documents.sparkSession
    docs = blocks.narrow(blocks.scanned(documents), "doc_id", "text").where("doc_id is not null")
    # each step's shuffles are done with when its table is written
    sets = blocks.written(sets_of(docs, n, t), "sets")
    blocks.release(spark)
    distinct = sets.where("tokens is not null").groupBy("id").agg(F.count("*").alias("copies"), F.any_value(F.struct("size", "tokens", "levels")).alias("x"))
    active = blocks.written(distinct.select("id", "copies", "x.*"), "active")
    blocks.release(spark)
    # a tenth of the tokens come this far
    shards = max(1, _partitions(spark) // 4)
    count = sets.count()
    crowd = crowds(active, count, t, shards)
    marked = active.join(crowd.select("id", "crowd"), "id", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0).cast("long")))
    pairs = blocks.written(candidates(index_sets(marked, count, t, shards), t, shards), "pairs")
    return sets, active, crowd, pairs


def _verified(active: DataFrame, crowd: DataFrame, pairs: DataFrame, t: float, each: bool = False) -> DataFrame:
    return verify(active, pairs, t, each).unionByName(verify_crowds(active, crowd, t, each))


def join(documents: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): pairs of documents that stand for their token sets, and each
    document with the one of lowest doc_id that has the same set."""
    sets, active, crowd, pairs = _prepared(documents, n, t)
    sets = sets.where("id is not null").select("doc_id", "id")
    lead = sets.groupBy("id").agg(F.min("doc_id").alias("lead"))
    near = (
        _verified(active, crowd, pairs, t, each=True).join(lead.select(F.col("id").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("id").alias("b"), F.col("lead").alias("y")), "b")
        .where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    )
    copies = sets.join(lead, "id").where("doc_id <> lead").select(F.col("lead").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(copies).distinct()


def classes(documents: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links), a row per row of documents that has a doc_id: the lowest doc_id of those that it is
    connected with by pairs of similarity t or more, and how many other documents it forms such pairs with."""
    sets, active, crowd, pairs = _prepared(documents, n, t)
    found = blocks.written(_verified(active, crowd, pairs, t), "found")
    blocks.release(documents.sparkSession)
    forest = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = sets.where("id is not null").groupBy("id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("lead"))
    own = own.join(links, "id", "left").join(forest, "id", "left").select("id", "lead", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    own = blocks.written(own.where("links > 0"), "linked")
    least = own.groupBy("root").agg(F.min("lead").alias("class_id"))
    known = own.join(least, "root").select("id", "class_id", "links")
    return sets.select("doc_id", "id").join(known, "id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id of edges (a, b): root is the lowest id that it is connected with.

    Alternates large and small stars, so the rounds grow with the logarithm of the longest chain; each
    round is written to the shared folder.  Empty edges give no rows.
    """
    star = blocks.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star")
    before = None
    while True:
        state = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return star.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id").unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct().join(star.select(F.col("a").alias("id")), "id", "left_anti"))
        before = state
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        star = blocks.written(small.where("a <> b").distinct(), "star")


def keep_one(documents: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """documents without those connected with one of a lower doc_id by pairs of the join.

    Rows of one doc_id that repeat are left as they are (they share its fate); rows of a null
    doc_id stay.
    """
    gone = classes(documents, n, t).groupBy("doc_id").agg(F.min("class_id").alias("class_id")).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    gone = blocks.written(gone, "gone")
    few = gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return documents.join(F.broadcast(gone) if few else gone.hint("merge"), documents["doc_id"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER = "".join(map(chr, [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]))
_LOWER = "".join(chr(ord(c) + 32) for c in _UPPER)
#: For one row per doc_id: the query's words, their N-grams, all similar pairs, and the pairs' transitive closure.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' '))) END AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS token FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same, any_value(a.n) AS m, any_value(b.n) AS n FROM t a JOIN t b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM o WHERE same / CAST(m + n - same AS DOUBLE) >= {THRESHOLD} - 1e-9),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, least(doc_id, coalesce(lowest, doc_id)) AS class_id, coalesce(links, 0) AS links
FROM w LEFT JOIN (SELECT a AS doc_id, min(b) AS lowest FROM r GROUP BY a) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a) USING (doc_id)
"""
