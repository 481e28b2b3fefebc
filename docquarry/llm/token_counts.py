"""Operator 10, token counts: a digest cache.

Counts are stored in a Parquet table under (digest of the normalised content, digest of the tokenizer's
files and settings).  Counting a corpus:

1. One pass digests the normalised texts (NFC, line ends as LF); the row ids and 16-byte digests are written.
2. The distinct digests are joined to those stored for this tokenizer version; the rest are the misses.
3. A second pass carries the texts of misses, compressed, to one place per digest, where each is encoded
   once, whole; the counts are appended to the cache.  Without a miss there is no second pass.
4. The row ids are joined to the stored counts.

The append is one committed job: a run that dies before it leaves the cache as it was, one that is repeated finds
its digests there.  Should two runs append the same digest, readers take one of them.

Defined results: a null text has a null digest and 0 tokens, an empty text 0 tokens; repeated rows are counted
each; text that looks like a special token is ordinary text.  cached tells whether the
count was there before this run.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata

import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docquarry.llm import blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut before the merges: contractions, letters, digits, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SETTINGS = "nfc,lf,ordinary;1"
CACHE_SCHEMA = "digest binary, tokenizer string, tokens long"
#: So many misses' digests, 16 bytes each, are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000


@functools.lru_cache(2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("cached", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_digest(vocabulary: str) -> str:
    """Names a tokenizer's version: its vocabulary file's bytes, cutting pattern and settings."""
    h = hashlib.sha256(f"{PATTERN}\0{SETTINGS}\0".encode())
    with open(vocabulary, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()[:32]


def normalise(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(normalise(text).encode(), digest_size=16).digest()


def _digests(batches):
    for batch in batches:
        column = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if t is None else _digest(t) for t in column], pa.binary())], names=["doc_id", "digest"])


def _packed(wanted=None):
    """Digests and compressed texts, of the wanted digests (a broadcast set) only if they are known."""

    def run(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            for t in batch.column("text").to_pylist():
                if t is not None and (d := _digest(t)) not in seen and (wanted is None or d in wanted.value):
                    seen[d] = pack(normalise(t).encode())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "packed"])

    return run


def _encode(vocabulary: str):
    def run(batches):
        enc, unpack, seen = encoder(vocabulary), zstandard.ZstdDecompressor().decompress, set()
        for batch in batches:
            digests, counts = [], []
            for d, p in zip(batch.column("digest").to_pylist(), batch.column("packed"), strict=True):
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    counts.append(len(enc.encode_ordinary(unpack(p.as_py()).decode())))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "tokens"])

    return run


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, tokens) of one tokenizer version in the cache, which need not exist yet."""
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], CACHE_SCHEMA)
    return known.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("tokens").alias("tokens"))


def count(documents: DataFrame, cache: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, digest, tokens, cached), a row per row of documents; misses are appended to the cache."""
    spark = documents.sparkSession
    version = tokenizer_digest(vocabulary)
    docs = blocks.narrow(documents, "doc_id", "text")
    keyed = blocks.written(docs.mapInArrow(_digests, "doc_id long, digest binary"), "digests")
    missing = keyed.where("digest is not null").select("digest").distinct().join(stored(spark, cache, version), "digest", "left_anti")
    missing = blocks.written(missing, "missing")
    few = missing.limit(MOST_BROADCAST + 1).count()
    if few:
        # few misses thin out the texts before they are packed; many meet them where a digest's rows come together
        if few <= MOST_BROADCAST:
            wanted = spark.sparkContext.broadcast({bytes(r["digest"]) for r in missing.toLocalIterator()})
            texts = docs.mapInArrow(_packed(wanted), "digest binary, packed binary").repartition("digest")
        else:
            texts = docs.mapInArrow(_packed(), "digest binary, packed binary").repartition("digest").join(missing.hint("merge"), "digest", "left_semi")
        fresh = texts.mapInArrow(_encode(vocabulary), "digest binary, tokens long")
        fresh.select("digest", F.lit(version).alias("tokenizer"), "tokens").write.mode("append").parquet(cache)
    found = keyed.join(stored(spark, cache, version), "digest", "left").join(missing.withColumn("missed", F.lit(True)), "digest", "left")
    return found.select("doc_id", F.lower(F.hex("digest")).alias("digest"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("missed").isNull() & F.col("digest").isNotNull()).alias("cached"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for all documents, from a cache that begins empty."""
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"), blocks.scratch(spark, "token-cache"))
