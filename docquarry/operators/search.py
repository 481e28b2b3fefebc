"""Vector search, hybrid search and the 2-D point cloud."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.errors import QuarryError
from docquarry.functions import similarity as S


def least_score(percent: float) -> float:
    return percent / 50 - 1


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 5, min_percent: float = 0, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """(key, similarity_score, similarity_percent) of the k vectors nearest to query by cosine.

    Exact: one scan, a heap of k per task, merged; ties go to the higher key.  k of 0 or less returns all
    that pass the threshold.
    """
    q = F.lit([float(x) for x in query])
    # the query's norm is a constant that the optimizer folds
    score = S.cosine(F.col(embedding), q)
    found = vectors.select(key, score.alias("similarity_score")).where(F.col("similarity_score") >= least_score(min_percent))
    found = found.orderBy(F.desc("similarity_score"), F.desc(key))
    if k > 0:
        found = found.limit(k)
    return found.withColumn("similarity_percent", S.percent(F.col("similarity_score")))


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """(query_key, key, similarity_score, rank): the k nearest vectors of each row of queries, which are as many as they like.

    Both sides are dealt into p parts by their keys, and each of the p * p pairs of parts is a task of its own, of at most
    PART bytes a side.  It multiplies tiles in single precision, keeps what comes within SLACK of a query's k best so far, and scores that
    again exactly, term by term in double precision, so rounding in the products decides nothing.  No vector comes to the driver.
    """
    sides = _sized(queries, query_key, "embedding"), _sized(vectors, key, embedding)
    size = vectors.agg(F.count(embedding).alias("n"), F.max(F.size(embedding)).alias("dim")).first()
    many, cores = max(size["n"], queries.count()), vectors.sparkSession.sparkContext.defaultParallelism
    p = max(1, math.ceil(many * (size["dim"] or 0) * 8 / PART), min(math.ceil(math.sqrt(4 * cores)), math.ceil(many / TILE[0])))
    left, right = (_dealt(df, p, first) for df, first in zip(sides, (True, False), strict=True))
    pairs = left.unionByName(right).repartitionById(p * p, "pair")
    found = pairs.select("pair", "dim", "query", "ids", "data").mapInArrow(_nearest(k), "q long, v long, similarity_score double")
    best = F.expr(f"slice(sort_array(collect_list(struct(similarity_score, v)), false), 1, {int(k)})")
    merged = found.groupBy("q").agg(best.alias("b")).select("q", F.posexplode("b").alias("rank", "x"))
    return merged.select(F.col("q").alias(query_key), F.col("x.v").alias(key), "x.similarity_score", (F.col("rank") + 1).alias("rank"))


#: Queries and vectors of a tile; bytes of one side of a task; more than single precision can be wrong by for unit vectors of up to 4096 numbers.
TILE, PART, SLACK = (1024, 4096), 64 << 20, 1e-4


def _sized(df: DataFrame, key: str, embedding: str) -> DataFrame:
    df = df.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return df.where("id is not null and embedding is not null").withColumn("size", F.size("embedding"))


def _dealt(df: DataFrame, p: int, query: bool) -> DataFrame:
    """Rows of packed ids and vectors of one length, dealt into p parts by id, once for each pair of parts."""

    def run(batches):
        for batch in batches:
            ids, sizes = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            part = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % p
            for n, dim in np.unique(np.stack([part, sizes]), axis=1).T.tolist():
                own = batch.filter(pa.array((part == n) & (sizes == dim)))
                m = np.asarray(own.column(1).flatten().fill_null(np.nan), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([dim], pa.int32()), pa.array([np.asarray(own.column(0)).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["part", "dim", "ids", "data"])

    packed = df.select("id", "embedding", "size").mapInArrow(run, "part int, dim int, ids binary, data binary").withColumn("query", F.lit(query))
    other = F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("other")
    pair = F.col("part") * p + F.col("other") if query else F.col("other") * p + F.col("part")
    return packed.select("*", other).withColumn("pair", pair.cast("int")).drop("part", "other")


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in order."""
    return (a * b).cumsum(axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def _best_of(ids: np.ndarray, q: np.ndarray, keys: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, key, score) of the k nearest of v to each row of q."""
    lengths = lambda m: np.maximum(np.sqrt(_exact(m, m)), S.EPS)
    q_len, v_len = lengths(q), lengths(v)
    q32, v32 = (q / q_len[:, None]).astype(np.float32), (v / v_len[:, None]).astype(np.float32)
    rows, found, scores = [], [], []
    for at in range(0, len(q), TILE[0]):
        unit = q32[at : at + TILE[0]]
        n = len(unit)
        row, key, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, -np.inf)
        for begin in range(0, len(v), TILE[1]):
            s = unit @ v32[begin : begin + TILE[1]].T
            bound = least - SLACK
            if s.shape[1] > k:  # at least k of this tile are as near as its k-th
                bound = np.maximum(bound, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * SLACK) if begin == 0 else bound
            r, c = np.nonzero(~(s < bound[:, None].astype(np.float32)))
            for part in range(0, len(r), 1 << 16):  # equal vectors may be many
                x, y = r[part : part + (1 << 16)], c[part : part + (1 << 16)] + begin
                exact = np.clip(_exact(v[y], q[at + x]) / (v_len[y] * q_len[at + x]), -1, 1)
                row, key, score = np.r_[row, x], np.r_[key, keys[y]], np.r_[score, exact]
                order = np.lexsort((-key, -score, row))
                row, key, score = row[order], key[order], score[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, key, score, nth = row[nth < k], key[nth < k], score[nth < k], nth[nth < k]
                least[row[nth == k - 1]] = score[nth == k - 1]
        rows.append(row + at)
        found.append(key)
        scores.append(score)
    return ids[np.concatenate(rows)], np.concatenate(found), np.concatenate(scores)


def _nearest(k: int):
    def run(batches):
        held: dict = {}
        for batch in batches:
            for pair, dim, query, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                side = held.setdefault((pair, dim), ([], []))[not query]
                side.append((np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim)))
        for sides in held.values():
            if all(sides) and k > 0:
                q, v = ([np.concatenate(x) for x in zip(*side, strict=True)] for side in sides)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best_of(*q, *v, k)], names=["q", "v", "similarity_score"])

    return run


def best(scores: DataFrame, k: int, key: str, query: str) -> DataFrame:
    """scores with rank, the k best of each query; scores equal to 6 digits are ordered by the higher key."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 6)), F.desc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(dense: DataFrame, keyword: DataFrame, alpha: float = 0.5, k: int = 5, key: str = "chunk_id", query: str = "query_id") -> DataFrame:
    """(query, key, score, rank): alpha * dense + (1 - alpha) * keyword, the k best of each query; a key on one side only counts 0 on the other."""
    both = dense.select(query, key, (F.col("score") * alpha).alias("s")).unionByName(keyword.select(query, key, (F.col("score") * (1 - alpha)).alias("s")))
    return best(both.groupBy(query, key).agg(F.sum("s").alias("score")), k, key, query)


def keyword_scores(weights: DataFrame, query_terms: DataFrame, key: str, query: str = "query_id") -> DataFrame:
    """(query, key, score): cosines of sparse unit vectors, (key, term, weight) against (query, term, query_weight); a join on term."""
    return weights.join(query_terms, "term").groupBy(query, key).agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))


def point_cloud(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vectors with x and y, the first two principal components, instead of the embedding.

    The covariance is summed over all rows where they lie (dimension squared numbers); each
    component's sign is such that its largest loading is positive.
    """
    v = vectors.withColumn("_v", array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))
    if v.isEmpty():
        raise QuarryError("there are no vectors to project")
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(v)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), range(2)])
    from pyspark.ml.stat import Summarizer

    mean = v.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    base = mean @ loadings
    p = model.transform(v).withColumn("_p", vector_to_array("_p"))
    xy = [((F.col("_p")[k] - float(base[k])) * float(signs[k] or 1)).alias("xy"[k]) for k in range(2)]
    return p.select(*[c for c in vectors.columns if c != embedding], *xy)


def centroids(points: DataFrame, by: str) -> DataFrame:
    """Mean point of each group."""
    return points.groupBy(by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def mean_and_error(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, sem): mean and its standard error."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))
