"""A store: documents, chunks, vectors, pages and a graph as Parquet tables under versioned manifests.

Every change writes new table folders and then a manifest of the next number, which names the folders
of each table.  A writer claims that number by a file that only one can create, writes the manifest beside it and
renames it, so a manifest is whole or not there.  An operation reads one manifest from its beginning to its end, and
commits only on that one: if another writer came first, it begins again, for at most lock_timeout seconds, and then fails
with ConcurrencyError, leaving nothing visible.  A claim without a manifest is removed after that time.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.errors import ConcurrencyError, ConfigurationError, FileHandlingError, ParsingError
from docquarry.functions import chunk as C
from docquarry.functions import security
from docquarry.functions.clean import Cleaner, get_cleaner
from docquarry.operators import search
from docquarry.operators.pages import SCHEMA as PAGES
from docquarry.operators.pages import PageIndex
from docquarry.operators.vectorizers import TfIdfVectorizer, embed, get_vectorizer, public, unique_name
from docquarry.plans.transactions import changing
from docquarry.sources import parsers

SCHEMAS = {
    "documents": "doc_id long, file_path string, file_hash string, metadata binary, is_encrypted boolean, added_timestamp timestamp",
    "chunks": "chunk_id long, doc_id long, chunk_text binary, start_pos int, end_pos int, chunk_seq int, tags array<string>, is_encrypted boolean, graph_processed_at timestamp",
    "vectors": "chunk_id long, embedding array<float>",
    "blanks": "doc_id long, chunk_seq int, chunk_text binary, is_encrypted boolean",
    "pages": PAGES,
    "nodes": "node_id long, node_label string, node_properties string, unique_signature string, node_vector array<float>",
    "relationships": "relationship_id long, source_node_id long, target_node_id long, relationship_type string, relationship_properties string",
    "links": "node_id long, chunk_id long",
}
PREFIX_END = "------------------------"
#: What Java's (?U)\\s matches.  Chunks that are embedded at once.
BLANK, AT_ONCE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000", 2048


def metadata_prefix(metadata: dict | None) -> str:
    if not metadata:
        return ""
    return "--- Document Context ---\n" + "\n".join(f"{str(k).title()}: {v}" for k, v in metadata.items()) + f"\n{PREFIX_END}\n\n"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that all executors share: in spark.checkpoint.dir; on one machine a temporary folder will do."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigurationError("a temporary store on a cluster needs spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix=f"{name}-")


class Store:
    """A store at path; ':tempfile:' is a folder removed on close."""

    def __init__(
        self, spark: SparkSession, path: str = ":tempfile:", vectorizer: str = "hashing", vectorizer_config: dict | None = None, chunk_size: int = 384, chunk_overlap: int = 50, chunking_strategy: str = "token", tokenizer: dict | None = None,
        text_cleaner: str | Cleaner | None = "basic", password: str | None = None, expand_before: int = 0, expand_after: int = 0, chunk_processor=None, name: str = "", description: str = "", metadata: dict | None = None, lock_timeout: float = 60,
    ):
        if chunking_strategy not in C.STRATEGIES:
            raise ValueError(f"unknown chunking strategy: {chunking_strategy!r}")
        self.spark, self._lock, self._temporary = spark, threading.RLock(), path == ":tempfile:"
        self.path, self.lock_timeout, self._pinned = shared_path(spark, "store") if self._temporary else path, lock_timeout, None
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.chunk_size, self.chunk_overlap, self.strategy, self.tokenizer = chunk_size, chunk_overlap, chunking_strategy, tokenizer
        self._clean, self._processor, self._expand = get_cleaner(text_cleaner) if text_cleaner is not None else None, chunk_processor, {"expand_before": expand_before, "expand_after": expand_after}
        manifest = self._manifest()
        info = {"unique_name": unique_name(vectorizer, vectorizer_config), "vectorizer_name": vectorizer, "vectorizer_config": public(vectorizer_config)}
        known = manifest["properties"]
        if known.get("vectorizer_info", info)["unique_name"] != info["unique_name"]:
            raise ConfigurationError(f"the store was made with vectorizer {known['vectorizer_info']['unique_name']}, not {info['unique_name']}")
        self.vectorizer = get_vectorizer(vectorizer, vectorizer_config)
        if isinstance(self.vectorizer, TfIdfVectorizer) and "idf" in known:
            self.vectorizer.idf = known["idf"]
        salt = bytes.fromhex(known["salt"]) if "salt" in known else security.new_salt()
        self._key = security.derive_key(password, salt)
        # what is stored holds against what is given
        self.properties = {"vectorizer_info": info, "salt": salt.hex(), "name": name, "description": description, "metadata": metadata or {}, "graph_features_enabled": False} | known
        if not known:
            self._commit(manifest["version"], manifest["tables"])
        self.pages = PageIndex(self)

    # manifests and tables

    def _p(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))

    def _manifest(self) -> dict:
        folder = self._p("manifests")
        if not self._fs.exists(folder):
            return {"version": 0, "tables": {}, "properties": {}}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        versions = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if not versions:
            return {"version": 0, "tables": {}, "properties": {}}
        stream = self._fs.open(self._p("manifests", f"{versions[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, tables: dict) -> None:
        body = json.dumps({"version": version + 1, "tables": tables, "properties": self.properties})
        claim, final = (self._p("manifests", f"{version + 1:012d}.{end}") for end in ("claim", "json"))
        try:
            self._fs.create(claim, False).close()
        except Exception as e:
            if not self._fs.exists(final) and self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > self.lock_timeout:
                if self._fs.delete(claim, False):  # its writer died
                    return self._commit(version, tables)
            raise ConcurrencyError(f"another writer changed {self.path}") from e
        part = self._p("manifests", f"{version + 1:012d}.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(body.encode())
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise ConcurrencyError(f"another writer changed {self.path}")

    @contextmanager
    def transaction(self):
        """Within it the tables are those of one manifest, and changes are committed on that one only."""
        with self._lock:
            if self._pinned is not None:
                yield
                return
            self._pinned = self._manifest()
            try:
                yield
            finally:
                self._pinned = None

    def vacuum(self, older_than: float = 86_400) -> int:
        """Removes table and staging folders that the newest manifest doesn't name and nobody wrote to for so many seconds; how many."""
        used, gone, now = {f for folders in self._manifest()["tables"].values() for f in folders}, 0, time.time()
        for kind in ("staging", *SCHEMAS):
            if self._fs.exists(self._p(kind)):
                for s in self._fs.listStatus(self._p(kind)):
                    if f"{kind}/{s.getPath().getName()}" not in used and now - s.getModificationTime() / 1000 >= older_than:
                        gone += self._fs.delete(s.getPath(), True)
        return gone

    def table(self, name: str) -> DataFrame:
        folders = (self._pinned or self._manifest())["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def change(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> None:
        """Replaces and appends to tables, all or nothing; frames made from the store's tables belong into one transaction with it."""
        with self.transaction():
            manifest = self._pinned
            tables = dict(manifest["tables"])
            for new, frames in ((True, replace or {}), (False, append or {})):
                for name, df in frames.items():
                    folder = f"{name}/{uuid.uuid4().hex}"
                    columns = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
                    df.select(*columns).write.parquet(f"{self.path}/{folder}")
                    tables[name] = [folder] if new else [*tables.get(name, []), folder]
            self._commit(manifest["version"], tables)
            self._pinned = manifest | {"version": manifest["version"] + 1, "tables": tables}

    def append(self, name: str, df: DataFrame) -> None:
        self.change(append={name: df})

    def next_id(self, name: str, key: str) -> int:
        return (self.table(name).agg(F.max(key)).first()[0] or 0) + 1

    def register_views(self, prefix: str = "") -> None:
        """The tables as temporary views, for spark.sql."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)

    @changing
    def compact(self) -> None:
        """Each table in one folder of few files."""
        self.change(replace={name: self.table(name).coalesce(max(1, self.spark.sparkContext.defaultParallelism)) for name in self._manifest()["tables"]})

    def _staged(self, df: DataFrame, what: str) -> DataFrame:
        folder = f"{self.path}/staging/{what}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def _numbered(self, df: DataFrame, order: list[str], first: int, key: str, takes: str = "1L") -> DataFrame:
        """df with numbers from first in that order, of which each row takes so many; given within range partitions that are stored before they are counted."""
        parts = self._staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_takes", F.expr(takes)), key)
        within = F.sum("_takes").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_takes")
        counts = parts.groupBy("_part").agg(F.sum("_takes").alias("_n"))
        before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
        return parts.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(key, F.col("_before") + F.col("_within") + F.lit(first)).drop("_part", "_takes", "_within", "_before")

    # ingest

    @changing
    def ingest(self, incoming: DataFrame, force: bool = False, vectorize_with_metadata: bool = True, chunk_size: int | None = None, chunk_overlap: int | None = None, strategy: str | None = None, skip_chunking: bool = False) -> DataFrame:
        """Adds or updates documents: incoming has file_path and text, and may have file_hash, metadata (JSON) and tags.

        Gives (file_path, status, num_chunks_added, num_chunks_ignored, change); status is new, changed, forced, unchanged, empty,
        ignored (all chunks blank, nothing written) or error (null text); change is new, changed or unchanged by the path and hash alone.
        Of repeated paths the greatest text counts.  Texts are stored once as they come and once as chunks with their vectors; what is
        grouped, joined and numbered are rows without text, but for one join of new chunks with the ids of their documents.
        """
        spark, has = self.spark, set(incoming.columns)
        option = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
        df = incoming.select("file_path", F.col("text").cast("string").alias("text"), option("file_hash", "string"), option("metadata", "string"), option("tags", "array<string>"))
        df = df.withColumn("file_hash", F.coalesce("file_hash", F.sha2(F.encode("text", "UTF-8"), 256)))
        given = self._staged(df if self._clean is None else df.withColumn("clean", self._clean(F.col("text"))), "given")
        clean, columns = "text" if self._clean is None else "clean", given.columns[1:]
        twice = given.groupBy(F.col("file_path").alias("_p")).count().where("count > 1").select("_p")
        if not twice.isEmpty():
            same_path = F.col("file_path").eqNullSafe(F.col("_p"))
            one = given.join(twice, same_path, "left_semi").groupBy("file_path").agg(F.max(F.struct(*columns)).alias("x")).select("file_path", "x.*")
            given = self._staged(given.join(twice, same_path, "left_anti").unionByName(one), "given")
        judged = given.select("file_path", "file_hash", "metadata", "tags", F.col("text").isNull().alias("_missing"), (~F.col(clean).rlike("(?U)\\S")).alias("_blank"))
        filled = bool(self._pinned["tables"].get("documents"))
        if filled:
            known = self.table("documents").select("file_path", "doc_id", F.col("file_hash").alias("old_hash"))
            indexed = self.table("chunks").join(self.table("vectors").select("chunk_id"), "chunk_id", "left_semi").select("doc_id").distinct().withColumn("indexed", F.lit(True))
            judged = judged.join(known, "file_path", "left").join(indexed, "doc_id", "left")
        else:
            judged = judged.withColumns({"doc_id": F.lit(None).cast("long"), "old_hash": F.lit(None).cast("string"), "indexed": F.lit(None).cast("boolean")})
        same = (F.col("file_hash") == F.col("old_hash")) & F.col("indexed") & ~F.lit(force)
        judged = self._staged(judged.withColumns({
            "status": F.when(F.col("_missing"), "error").when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("_blank"), "empty").when(F.col("doc_id").isNull(), "new").when(F.col("file_hash") == F.col("old_hash"), "forced").otherwise("changed"),
            "change": F.when(F.col("doc_id").isNull(), "new").when(F.col("file_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed"),
        }).drop("_missing", "_blank", "indexed"), "judged")
        size, overlap = chunk_size or self.chunk_size, self.chunk_overlap if chunk_overlap is None else chunk_overlap
        # a new text that is blank is kept as blank chunks
        todo = judged.where(F.col("status").isin("new", "changed", "forced") | ((F.col("status") == "empty") & F.col("doc_id").isNull()))
        work = given.join(todo.select("file_path"), "file_path", "left_semi") if filled else given.where(F.col("text").isNotNull())
        chunks = self._staged(self._chunked(work.select("file_path", F.col(clean).alias("text"), "metadata", "tags"), strategy or self.strategy, size, overlap, skip_chunking, vectorize_with_metadata), "chunks")
        counts = chunks.groupBy("file_path").agg(F.count_if(~F.col("blank")).alias("added"), F.count_if("blank").alias("ignored"), F.collect_list(F.when(F.col("blank"), F.col("chunk_seq"))).alias("blanks"))
        done = judged.join(counts, "file_path", "left").withColumns({"added": F.coalesce("added", F.lit(0)), "ignored": F.when(F.col("status") == "empty", 0).otherwise(F.coalesce("ignored", F.lit(0)))})
        done = self._staged(done.withColumn("status", F.when(F.col("status").isin("new", "changed", "forced") & (F.col("added") == 0), "ignored").otherwise(F.col("status"))), "status")
        self._write(done, chunks)
        return done.select("file_path", "status", F.col("added").alias("num_chunks_added"), F.col("ignored").alias("num_chunks_ignored"), "change")

    def _late(self) -> bool:
        """Chunks can be embedded only when all are there."""
        return isinstance(self.vectorizer, TfIdfVectorizer) and self.vectorizer.idf is None

    def _chunked(self, work: DataFrame, strategy: str, size: int, overlap: int, whole: bool, with_metadata: bool) -> DataFrame:
        """(file_path, tags, chunk_seq, blank, storage_text, embedding) of each chunk; embed_text, the vector text after the metadata's
        prefix, if it is embedded later.  whole: each text is one chunk, of which the first size tokens are embedded."""
        if not whole:
            if strategy not in C.STRATEGIES:
                raise ValueError(f"unknown chunking strategy: {strategy!r}")
            if strategy in ("character", "token") and overlap >= size:
                raise ValueError("the overlap must be smaller than the chunk size")
        C.get_tokenizer(self.tokenizer)
        processor, config, expand, late = self._processor, self.tokenizer, self._expand, self._late()
        shared = self.spark.sparkContext.broadcast(self.vectorizer)
        fields = [("file_path", pa.string()), ("tags", pa.list_(pa.string())), ("chunk_seq", pa.int32()), ("blank", pa.bool_()), ("storage_text", pa.string()), ("embed_text", pa.string())]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
            if not late:
                vectors = np.asarray(shared.value.vectorize([r[-1] for r in rows]), np.float32)
                columns[-1] = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel(), pa.float32()))
            return pa.RecordBatch.from_arrays(columns, names=[*(n for n, _ in fields[:-1]), "embed_text" if late else "embedding"])

        def run(batches):
            tok, rows = C.get_tokenizer(config), []
            for batch in batches:
                for path, text, metadata, tags in zip(*(batch.column(c).to_pylist() for c in ("file_path", "text", "metadata", "tags")), strict=True):
                    meta = json.loads(metadata) if metadata else {}
                    prefix = metadata_prefix(meta) if with_metadata else ""
                    text = text or ""
                    found = [(tok.decode(tok.encode(text)[:size]), text)] if whole else C.generate_chunks(text, strategy, size, overlap, tokenizer=tok, vectorizer_fn=shared.value.vectorize, **expand)
                    for k, (vector, stored) in enumerate(found):
                        if processor is not None:
                            vector, stored = processor(vector, meta), processor(stored, meta)
                        rows.append((path, tags, k, not vector.strip(BLANK), stored, prefix + vector))
                        if len(rows) == AT_ONCE:
                            yield made(rows)
                            rows = []
            if rows:
                yield made(rows)

        last = "embed_text string" if late else "embedding array<float>"
        return work.mapInArrow(run, f"file_path string, tags array<string>, chunk_seq int, blank boolean, storage_text string, {last}")

    def _write(self, done: DataFrame, chunks: DataFrame) -> None:
        sealed = lambda c: security.encrypt(c, self._key) if self._key else F.encode(c, "UTF-8")
        wrote = F.col("status").isin("new", "changed", "forced")
        if done.where(wrote | (F.col("status") == "empty")).isEmpty():
            return
        documents = self.table("documents")
        fresh = done.where(F.col("doc_id").isNull() & (wrote | (F.col("status") == "empty")))
        fresh = self._numbered(fresh.drop("doc_id"), ["file_path"], self.next_id("documents", "doc_id"), "doc_id")
        columns = ["doc_id", "file_path", "file_hash", "metadata", "status", "added", "blanks"]
        ids = self._staged(fresh.select(*columns).unionByName(done.where(F.col("doc_id").isNotNull() & wrote).select(*columns)), "ids")
        row = ids.select(
            "doc_id", "file_path", "file_hash", F.when(F.col("status") != "empty", sealed(F.col("metadata"))).alias("metadata"),
            F.lit(self._key is not None).alias("is_encrypted"), F.current_timestamp().alias("added_timestamp"),
        )
        old = documents.join(ids.select("doc_id", F.col("file_path").alias("_p")), "doc_id", "left")
        stamp = old.where(F.col("_p").isNotNull()).select("doc_id", F.col("added_timestamp").alias("_t"))
        kept = old.where(F.col("_p").isNull()).drop("_p")
        row = row.join(stamp, "doc_id", "left").withColumn("added_timestamp", F.coalesce("_t", "added_timestamp")).drop("_t")
        gone = ids.select("doc_id")
        full, late = ~F.col("blank"), self._late()
        if late:
            self.properties["idf"] = self.vectorizer.fit(chunks.where(full), "embed_text").idf
        firsts = self._numbered(ids.select("file_path", "doc_id", "added", "blanks"), ["doc_id"], self.next_id("chunks", "chunk_id"), "first_chunk", "added")
        firsts = self._staged(firsts.drop("added"), "firsts")
        at = F.col("first_chunk") + F.col("chunk_seq") - F.expr("coalesce(size(filter(blanks, x -> x < chunk_seq)), 0)")
        numbered = chunks.join(firsts, "file_path").withColumn("chunk_id", F.when(full, at))
        new_chunks = numbered.where(full).select(
            "chunk_id", "doc_id", sealed(F.col("storage_text")).alias("chunk_text"), F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos"), "chunk_seq", F.array_sort(F.array_distinct("tags")).alias("tags"),
            F.lit(self._key is not None).alias("is_encrypted"), F.lit(None).cast("timestamp").alias("graph_processed_at"),
        )
        new_vectors = numbered.where(full)
        new_vectors = (embed(new_vectors.select("chunk_id", "embed_text"), self.vectorizer, "embed_text") if late else new_vectors).select("chunk_id", "embedding")
        blanks = {} if chunks.where("blank").isEmpty() else {"blanks": numbered.where("blank").select("doc_id", "chunk_seq", sealed(F.col("storage_text")).alias("chunk_text"), F.lit(self._key is not None).alias("is_encrypted"))}
        stale = self.table("chunks").join(gone, "doc_id", "left_semi").select("chunk_id")
        if stale.isEmpty() and stamp.isEmpty():
            self.change(append={"documents": row, "chunks": new_chunks, "vectors": new_vectors} | blanks)
            return
        if blanks or self._pinned["tables"].get("blanks"):
            kept_blanks = self.table("blanks").join(gone, "doc_id", "left_anti")
            blanks = {"blanks": kept_blanks.unionByName(blanks["blanks"]) if blanks else kept_blanks}
        self.change(replace=blanks | {
            "documents": kept.unionByName(row), "chunks": self.table("chunks").join(gone, "doc_id", "left_anti").unionByName(new_chunks),
            "vectors": self.table("vectors").join(stale, "chunk_id", "left_anti").unionByName(new_vectors), "links": self.table("links").join(stale, "chunk_id", "left_anti"),
        })

    def add_text(self, unique_id: str, text: str, metadata: dict | None = None, tags: list[str] | None = None, force_reindex: bool = False, **options) -> dict:
        return self._add(unique_id, text, None, metadata, tags, force_reindex, options)

    def add_document(self, path: str, metadata: dict | None = None, tags: list[str] | None = None, force_reindex: bool = False, **options) -> dict:
        """A file; what can't be parsed counts as no chunks."""
        if not os.path.isfile(path):
            raise FileHandlingError(f"File not found when trying to hash: {path}")
        with open(path, "rb") as f:
            data = f.read()
        try:
            text = parsers.parse_bytes(path, data)
        except ParsingError:
            return {"num_chunks_added": 0, "num_chunks_ignored": 0}
        return self._add(os.path.abspath(path), text, hashlib.sha256(data).hexdigest(), metadata, tags, force_reindex, options)

    def _add(self, path, text, file_hash, metadata, tags, force, options) -> dict:
        row = self.spark.createDataFrame([(path, text, file_hash, json.dumps(metadata) if metadata else None, tags)], "file_path string, text string, file_hash string, metadata string, tags array<string>")
        r = self.ingest(row, force, **options).first()
        return {"num_chunks_added": r["num_chunks_added"], "num_chunks_ignored": r["num_chunks_ignored"]}

    # reading

    def _open(self, column: str) -> F.Column:
        opened = F.when(F.col("is_encrypted"), security.decrypt(F.col(column), self._key)).otherwise(F.decode(column, "UTF-8"))
        return F.when(F.col(column).isNotNull(), opened)

    @staticmethod
    def _metadata(text: str | None) -> dict | None:
        if text is None:
            return None
        if text in (security.KEY_MISSING, security.NOT_DECRYPTED):
            return {"error": text}
        try:
            return json.loads(text)
        except ValueError:
            return {"error": "Invalid JSON"}

    def documents(self) -> DataFrame:
        return self.table("documents").withColumn("metadata", self._open("metadata"))

    def chunks(self) -> DataFrame:
        """Chunks with their text opened, and file_path and metadata of their documents."""
        c = self.table("chunks").withColumn("chunk_text", self._open("chunk_text")).drop("is_encrypted")
        return c.join(self.documents().select("doc_id", "file_path", "metadata"), "doc_id")

    def vectorize_text(self, text: str):
        return self.vectorizer.vectorize([text])

    def query(self, text: str, top_k: int = 5, min_similarity_percent: float = 0.0) -> list[dict]:
        vector = self.vectorize_text(text)[0]
        found = search.top_k(self.table("vectors"), vector.tolist(), top_k, min_similarity_percent)
        # at most 10,000 rows of 24 bytes are broadcast
        rows = self.chunks().join(F.broadcast(found) if 0 < top_k <= 10_000 else found, "chunk_id").orderBy(F.desc("similarity_score"), F.desc("chunk_id")).collect()
        out = []
        for r in rows:
            meta = self._metadata(r["metadata"])
            out.append({"chunk_id": r["chunk_id"], "chunk_text": metadata_prefix(meta) + r["chunk_text"], "start_pos": r["start_pos"], "end_pos": r["end_pos"], "file_path": r["file_path"], "document_metadata": meta, "similarity_score": r["similarity_score"], "similarity_percent": r["similarity_percent"], "doc_id": r["doc_id"], "chunk_seq": r["chunk_seq"]})
        return out

    def list_documents(self) -> list[dict]:
        return [r.asDict() | {"metadata": self._metadata(r["metadata"])} for r in self.documents().drop("is_encrypted").orderBy("doc_id").collect()]

    def get_chunk_by_id(self, chunk_id: int) -> dict | None:
        r = self.chunks().where(F.col("chunk_id") == chunk_id).first()
        return None if r is None else {"chunk_id": r["chunk_id"], "chunk_text": r["chunk_text"], "file_path": r["file_path"], "document_metadata": self._metadata(r["metadata"])}

    def reconstruct(self, which: F.Column | None = None) -> DataFrame:
        """(file_path, text): each document's chunks, blank ones too, joined by line ends, '' without chunks; of all documents or some."""
        documents = self.table("documents") if which is None else self.table("documents").where(which)
        chunks = self.table("chunks").select(*(columns := ["doc_id", "chunk_seq", "chunk_text", "is_encrypted"]))
        if (self._pinned or self._manifest())["tables"].get("blanks"):
            chunks = chunks.unionByName(self.table("blanks").select(*columns))
        chunks = chunks if which is None else chunks.join(documents, "doc_id", "left_semi")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "chunk_text"))), lambda x: x["chunk_text"]), "\n")
        joined = chunks.withColumn("chunk_text", self._open("chunk_text")).groupBy("doc_id").agg(text.alias("text"))
        return documents.select("doc_id", "file_path").join(joined, "doc_id", "left").select("file_path", F.coalesce("text", F.lit("")).alias("text"))

    def reconstruct_document_text(self, file_path: str) -> str | None:
        r = self.reconstruct(F.col("file_path") == file_path).first()
        return None if r is None else r["text"]

    @changing
    def delete_document_by_id(self, doc_id: int) -> None:
        self._delete(self.table("documents").where(F.col("doc_id") == doc_id).select("doc_id"))

    @changing
    def delete_document_by_path(self, file_path: str) -> None:
        self._delete(self.table("documents").where(F.col("file_path") == file_path).select("doc_id"))

    def _delete(self, docs: DataFrame) -> None:
        if docs.isEmpty():
            return
        gone = self.table("chunks").join(docs, "doc_id", "left_semi").select("chunk_id")
        self.change(replace={name: self.table(name).join(docs, "doc_id", "left_anti") for name in ("documents", "chunks", "blanks", "pages")} | {name: self.table(name).join(gone, "chunk_id", "left_anti") for name in ("vectors", "links")})

    def get_vectorization_details(self) -> dict | None:
        return self.properties.get("vectorizer_info")

    def list_vectorization_methods(self) -> list[dict]:
        return [self.properties["vectorizer_info"]]

    def point_cloud(self) -> DataFrame:
        v = search.point_cloud(self.table("vectors"))
        return v.join(self.chunks().select("chunk_id", "file_path", "metadata"), "chunk_id").select("x", "y", "chunk_id", F.element_at(F.split("file_path", "/"), -1).alias("document_title"), F.col("file_path").alias("document_path"), "metadata")

    def export_point_cloud(self, output_format: str = "json_str"):
        if output_format not in ("json_str", "dict", "csv"):
            raise ValueError(f"unknown output format: {output_format}")
        rows = [r.asDict() | {"metadata": self._metadata(r["metadata"]) or {}} for r in self.point_cloud().orderBy("chunk_id").collect()]
        if output_format == "dict":
            return rows
        if output_format == "json_str":
            return json.dumps(rows)
        import csv
        import io

        flat = [{k: v for k, v in r.items() if k != "metadata"} | {f"meta_{k}": v for k, v in r["metadata"].items()} for r in rows]
        out = io.StringIO()
        w = csv.DictWriter(out, list(dict.fromkeys(k for r in flat for k in r)))
        w.writeheader()
        w.writerows(flat)
        return out.getvalue()

    def close(self) -> None:
        if self._temporary and self.spark.sparkContext._jsc is not None:
            self._fs.delete(self._p(), True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()
