"""A property graph: extraction, fusion, traversal, and the tables' upkeep."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.errors import GraphError, LLMCallbackError, NodeNotFoundError, QueryError, RelationshipNotFoundError
from docquarry.functions.jsonrepair import parse_json
from docquarry.operators import search, sparql
from docquarry.operators.vectorizers import embed
from docquarry.plans.transactions import changing

IDENTIFIERS = ("identifying_value", "name", "title", "id", "identifier")
DIRECTIONS = ("outgoing", "incoming", "any")
FAN = 100
#: Guidance may ask for no more hops than these.
MOST_HOPS = 10


def identifying_parts(properties: dict) -> tuple[str, object] | None:
    """First identifier that has a value, else the first scalar that has one."""
    for k in IDENTIFIERS:
        if properties.get(k):
            return k, properties[k]
    return next(((k, v) for k, v in properties.items() if v and isinstance(v, (str, int, float, bool))), None)


def signature(label: str, properties: dict, fallback: str = "unidentified") -> str:
    found = identifying_parts(properties)
    return f"{label}:{found[0]}:{str(found[1]).strip().lower()}" if found else f"{fallback}:{label}:{uuid.uuid4()}"


def node_text(label: str, properties: dict) -> str:
    parts = [f"{k} is {v}" for k, v in properties.items() if isinstance(v, (str, int, float, bool))]
    return f"An entity of type {label}" + (f" where {' and '.join(parts)}" if parts else "")


def directed(relationships: DataFrame, direction: str = "any") -> DataFrame:
    """relationships with at and to: the node it is seen from and the one it leads to."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    out = relationships.withColumns({"at": F.col("source_node_id"), "to": F.col("target_node_id")})
    back = relationships.withColumns({"at": F.col("target_node_id"), "to": F.col("source_node_id")})
    if direction == "outgoing":
        return out
    # a loop is seen once
    return back if direction == "incoming" else out.unionByName(back.where("source_node_id <> target_node_id"))


def specs_of(types) -> list[tuple[str | None, str]]:
    """(type, direction) of relationships to pass: from types, or objects with type and direction; any if there are none."""
    specs = []
    for t in types or []:
        kind, direction = (t.get("type"), t.get("direction") or "any") if isinstance(t, dict) else (t, "any") if isinstance(t, str) else t
        if not isinstance(kind, str) or direction not in DIRECTIONS:
            raise ValueError(f"not a relationship to pass: {t!r}")
        specs.append((kind, direction))
    return list(dict.fromkeys(specs)) or [(None, "any")]


def expand(nodes: DataFrame, relationships: DataFrame, seeds: DataFrame, depth: int, types: list | None = None, labels: list[str] | None = None, fan: int = FAN, cut=lambda df, what: df) -> tuple[DataFrame, DataFrame]:
    """(node_id, depth) reached from seeds (node_id) in at most depth hops, and the relationships passed.

    Breadth first, all nodes of a hop at once.  types names relationships' types, or objects of type and
    direction (specs_of); for each of these a node passes at most fan relationships, those of lowest id.
    A node whose label isn't wanted is left out, its relationship is kept; seeds are kept in any case.
    cut stores a frame between hops.
    """
    e = None
    for k, (kind, direction) in enumerate(specs_of(types)):
        some = relationships if kind is None else relationships.where(F.col("relationship_type") == kind)
        some = directed(some, direction).withColumn("spec", F.lit(k))
        e = some if e is None else e.unionByName(some)
    order = Window.partitionBy("at", "spec").orderBy("relationship_id")
    reached = cut(seeds.select("node_id").distinct().withColumn("depth", F.lit(0)), "reached")
    passed = None
    for hop in range(1, depth + 1):
        frontier = reached.where(F.col("depth") == hop - 1).select(F.col("node_id").alias("at"))
        step = e.join(frontier, "at", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fan).select("relationship_id", "to")
        step = cut(step, "step")
        ids = step.select("relationship_id")
        passed = ids if passed is None else passed.unionByName(ids)
        new = step.select(F.col("to").alias("node_id")).distinct().join(reached, "node_id", "left_anti")
        if labels:
            new = new.join(nodes.where(F.col("node_label").isin(list(labels))).select("node_id"), "node_id", "left_semi")
        reached = cut(reached.unionByName(new.withColumn("depth", F.lit(hop))), "reached")
    empty = relationships.limit(0)
    return reached, empty if passed is None else relationships.join(passed.distinct(), "relationship_id", "left_semi")


def edge_label(properties: Column, kind: Column) -> Column:
    some = lambda path: F.nullif(F.get_json_object(properties, path), F.lit(""))
    return F.coalesce(some("$.name"), some("$.label"), kind)


def owners(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, doc_id) of the nodes that are linked to chunks of one document only."""
    owned = links.join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("node_id").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other"))
    return owned.where("doc_id = other").select("node_id", "doc_id")


def exclusive_nodes(links: DataFrame, chunks: DataFrame, doc_id: int) -> DataFrame:
    """(node_id) of the nodes linked to chunks of that document and of no other."""
    return owners(links, chunks).where(F.col("doc_id") == doc_id).select("node_id")


def holding(nodes: DataFrame, label: str, key: str, value: str) -> DataFrame:
    """Nodes of that label whose property key has value in it, in whatever case."""
    return nodes.where((F.col("node_label") == label) & F.contains(F.lower(F.get_json_object("node_properties", f"$.{key}")), F.lit(value.lower())))


def default_prompt(text: str, ontology: dict | str | None) -> str:
    return (
        "List the entities of the text and how they are related.\n" + format_ontology(ontology) + '\nAnswer with one JSON object: {"nodes": [{"label": ..., "properties": {...}}], '
        '"relationships": [{"source_node_label": ..., "source_node_identifying_value": ..., "target_node_label": ..., "target_node_identifying_value": ..., "type": ..., "properties": {...}}]}\n\nText:\n' + text
    )


def format_ontology(ontology: dict | str | None) -> str:
    if not ontology:
        return "Choose labels and types that suit the text."
    if isinstance(ontology, str):
        return ontology
    out = ["Labels of nodes:"]
    for label, about in ontology.get("nodes", {}).items():
        about = about if isinstance(about, dict) else {"description": about}
        out.append(f"- {label}: {about.get('description', '')} (properties: {', '.join(about.get('properties', {}))})")
    out.append("Types of relationships:")
    for kind, about in ontology.get("relationships", {}).items():
        about = about if isinstance(about, dict) else {"description": about}
        out.append(f"- {kind}: from {about.get('source', 'any')} to {about.get('target', 'any')}. {about.get('description', '')}")
    return "\n".join(out)


EXTRACTED = "chunk_id long, found string, error string"


def extract(chunks: DataFrame, llm: Callable[[str], str], ontology: dict | str | None = None, prompt: Callable[[str], str] | None = None, retries: int = 2) -> DataFrame:
    """(chunk_id, found: JSON, error) of each chunk (chunk_id, chunk_text); what fails after the retries has an error."""

    def run(batches):
        for batch in batches:
            out = []
            for chunk_id, text in zip(batch.column("chunk_id").to_pylist(), batch.column("chunk_text").to_pylist(), strict=True):
                ask = prompt(text or "") if prompt else default_prompt(text or "", ontology)
                said, found, error = "", None, None
                for attempt in range(retries + 1):
                    try:
                        said = llm(ask if not attempt else f"{ask}\n\nThis answer couldn't be read, answer with JSON alone:\n{said[:500]}")
                        found, error = json.dumps(parse_json(said)), None
                        break
                    except Exception as e:  # noqa: BLE001  the callback may raise anything
                        error = f"{type(e).__name__}: {e}"
                out.append({"chunk_id": chunk_id, "found": found, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("chunk_id", pa.int64()), ("found", pa.string()), ("error", pa.string())]))

    return chunks.select("chunk_id", "chunk_text").mapInArrow(run, EXTRACTED)


_NODE = pa.schema([("chunk_id", pa.int64()), ("position", pa.int32()), ("node_label", pa.string()), ("node_properties", pa.string()), ("unique_signature", pa.string())])
_EDGE = pa.schema([("chunk_id", pa.int64()), ("position", pa.int32()), *[(c, pa.string()) for c in ("s_label", "s_value", "t_label", "t_value", "relationship_type", "relationship_properties")]])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'string'}" for f in schema)


def extracted_nodes(found: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for chunk_id, text in zip(batch.column("chunk_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                value = json.loads(text) if text else {}
                for k, n in enumerate(value.get("nodes") or [] if isinstance(value, dict) else []):
                    if isinstance(n, dict) and n.get("label") and isinstance(n.get("properties"), dict):
                        label = str(n["label"])
                        rows.append({"chunk_id": chunk_id, "position": k, "node_label": label, "node_properties": json.dumps(n["properties"]), "unique_signature": signature(label, n["properties"])})
            yield pa.RecordBatch.from_pylist(rows, schema=_NODE)

    return found.mapInArrow(run, _ddl(_NODE))


def extracted_edges(found: DataFrame) -> DataFrame:
    keys = ("source_node_label", "source_node_identifying_value", "target_node_label", "target_node_identifying_value", "type")

    def run(batches):
        for batch in batches:
            rows = []
            for chunk_id, text in zip(batch.column("chunk_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                value = json.loads(text) if text else {}
                for k, r in enumerate(value.get("relationships") or [] if isinstance(value, dict) else []):
                    if isinstance(r, dict) and all(r.get(x) for x in keys):
                        s, sv, t, tv, kind = (str(r[x]) for x in keys)
                        rows.append(dict(zip(_EDGE.names, (chunk_id, k, s, sv.strip().lower(), t, tv.strip().lower(), kind, json.dumps(r.get("properties") or {})), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=_EDGE)

    return found.mapInArrow(run, _ddl(_EDGE))




class GraphStore:
    """The graph of a store.  llm is a function from prompt to answer; the tables change in whole batches."""

    def __init__(self, store, llm: Callable[[str], str] | None = None, ontology: dict | str | None = None, prompt: Callable[[str], str] | None = None):
        self._store, self._llm, self._ontology, self._prompt = store, llm, ontology, prompt
        if not store.properties.get("graph_features_enabled"):
            store.properties["graph_features_enabled"] = True
            store.change()

    def _t(self, name: str) -> DataFrame:
        return self._store.table(name)

    def _need(self) -> Callable[[str], str]:
        if self._llm is None:
            raise LLMCallbackError("building the graph needs an llm")
        return self._llm

    def _embedded(self, nodes: DataFrame) -> DataFrame:
        label = F.udf(lambda n, p: node_text(n, json.loads(p or "{}")), "string", useArrow=True)
        with_text = nodes.drop("node_vector").withColumn("_text", label("node_label", "node_properties"))
        return embed(with_text, self._store.vectorizer, "_text", "node_vector").drop("_text")

    # building

    def build_graph_for_all_documents(self) -> int:
        """Chunks not processed yet; returns how many there were."""
        return self._build(F.col("graph_processed_at").isNull())

    def build_graph_for_document(self, doc_id: int) -> int:
        return self._build(F.col("doc_id") == doc_id)

    def process_chunk_for_graph(self, chunk_id: int) -> int:
        return self._build(F.col("chunk_id") == chunk_id)

    def _build(self, which: Column) -> int:
        st = self._store
        todo = st._staged(st.chunks().where(which).select("chunk_id", "chunk_text"), "todo")
        n = todo.count()
        if not n:
            return 0
        found = st._staged(extract(todo, self._need(), self._ontology, self._prompt), "extracted")
        self._record(todo, found)
        return n

    @changing
    def _record(self, todo: DataFrame, found: DataFrame) -> None:
        """What was extracted, and that its chunks are done, in one change."""
        st, frames = self._store, self._fuse(found)
        now = F.when(F.col("_x").isNotNull(), F.current_timestamp()).otherwise(F.col("graph_processed_at"))
        marks = todo.select("chunk_id", F.lit(True).alias("_x"))
        chunks = st.table("chunks").join(marks, "chunk_id", "left").withColumn("graph_processed_at", now)
        st.change(replace={"chunks": chunks, "nodes": frames["nodes"], "links": frames["links"]}, append={"relationships": frames["relationships"]})

    def _fuse(self, found: DataFrame) -> dict[str, DataFrame]:
        """The tables' new contents.  Nodes of one signature are one node; its properties are those of the last chunk.  Endpoints are found by value."""
        st = self._store
        seen = st._staged(extracted_nodes(found), "seen")
        latest = seen.groupBy("unique_signature").agg(F.max_by(F.struct("node_label", "node_properties"), F.struct("chunk_id", "position")).alias("n")).select("unique_signature", "n.*")
        old = self._t("nodes")
        known = old.select("node_id", "unique_signature")
        both = latest.join(known, "unique_signature", "left")
        fresh = st._numbered(both.where("node_id is null").drop("node_id"), ["unique_signature"], st.next_id("nodes", "node_id"), "node_id")
        written = st._staged(self._embedded(both.where("node_id is not null").unionByName(fresh)), "nodes")
        nodes = old.join(written.select("node_id"), "node_id", "left_anti").unionByName(written)
        ids = nodes.select("node_id", "unique_signature")
        links = self._t("links").unionByName(seen.join(ids, "unique_signature").select("node_id", "chunk_id")).distinct()
        # of a label's nodes one is found by any of its identifiers' values; the lowest id wins
        # get_json_object gives a string's bare value, like the edges' own
        named = nodes.select("node_id", "node_label", F.explode(F.array(*[F.lower(F.trim(F.get_json_object("node_properties", f"$.{k}"))) for k in IDENTIFIERS])).alias("value")).where("value is not null").groupBy("node_label", "value").agg(F.min("node_id").alias("node_id"))
        named = named.unionByName(nodes.select("node_id", "node_label", F.element_at(F.split("unique_signature", ":"), -1).alias("value")).join(named, ["node_label", "value"], "left_anti").groupBy("node_label", "value").agg(F.min("node_id").alias("node_id")))
        side = lambda s, into: named.select(F.col("node_label").alias(f"{s}_label"), F.col("value").alias(f"{s}_value"), F.col("node_id").alias(into))
        edges = extracted_edges(found).join(side("s", "source_node_id"), ["s_label", "s_value"]).join(side("t", "target_node_id"), ["t_label", "t_value"])
        edges = st._numbered(edges, ["chunk_id", "position"], st.next_id("relationships", "relationship_id"), "relationship_id")
        return {"nodes": nodes, "links": links, "relationships": edges}

    # asking

    def query_graph(self, text: str, output_mode: str = "chunks_summary", top_k_nodes: int = 5, max_depth: int = 2, target_relationships: list | None = None, target_node_labels: list[str] | None = None) -> dict | list:
        """Seeds by vector search, then expansion.  output_mode: chunks_summary, graph_only or full."""
        if output_mode not in ("chunks_summary", "graph_only", "full"):
            raise ValueError(f"unknown output mode: {output_mode}")
        if self._llm is not None:
            try:
                guide = parse_json(self._llm(f'How should the graph be searched for this question? Answer with JSON: {{"max_depth": ..., "target_relationships": [...], "target_node_labels": [...]}}\n{text}'))
                deep, passed, labels = int(guide.get("max_depth", max_depth)), guide.get("target_relationships") or target_relationships, guide.get("target_node_labels") or target_node_labels
                specs_of(passed)
                if not all(isinstance(x, str) for x in labels or []):
                    raise TypeError("labels are strings")
                max_depth, target_relationships, target_node_labels = deep, passed, labels
            except Exception:  # noqa: BLE001  without guidance the defaults hold
                pass
        vector = self._store.vectorize_text(text)[0].tolist()
        seeds = search.top_k(self._t("nodes").where("node_vector is not null"), vector, top_k_nodes, key="node_id", embedding="node_vector")
        reached, passed = expand(self._t("nodes"), self._t("relationships"), seeds, min(max_depth, MOST_HOPS), target_relationships, target_node_labels, cut=self._store._staged)
        nodes = self._t("nodes").join(reached.select("node_id"), "node_id", "left_semi")
        graph = {"nodes": [self._node(r) for r in nodes.orderBy("node_id").collect()], "relationships": [self._edge(r) for r in passed.orderBy("relationship_id").collect()]}
        if output_mode == "graph_only":
            return graph
        linked = self._t("links").join(nodes.select("node_id", "node_label"), "node_id").groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("node_id", "node_label"))).alias("linked_graph_nodes"))
        chunks = [{"chunk_id": r["chunk_id"], "chunk_text": r["chunk_text"], "file_path": r["file_path"], "linked_graph_nodes": [x.asDict() for x in r["linked_graph_nodes"]]} for r in self._store.chunks().join(linked, "chunk_id").orderBy("chunk_id").collect()]
        return chunks if output_mode == "chunks_summary" else {"graph": graph, "chunks": chunks}

    def query_sparql(self, text: str) -> dict:
        try:
            return sparql.run(text, self._t("nodes"), self._t("relationships"))
        except QueryError:
            raise
        except Exception as e:
            raise QueryError(f"the query failed: {e}") from e

    @staticmethod
    def _node(r) -> dict:
        return {"node_id": r["node_id"], "label": r["node_label"], "properties": json.loads(r["node_properties"] or "{}"), "unique_signature": r["unique_signature"]}

    @staticmethod
    def _edge(r) -> dict:
        return {"relationship_id": r["relationship_id"], "source_node_id": r["source_node_id"], "target_node_id": r["target_node_id"], "type": r["relationship_type"], "properties": json.loads(r["relationship_properties"] or "{}")}

    # nodes

    @changing
    def add_node(self, label: str, properties: dict) -> int:
        """The node's id; one of that signature gets the new properties besides its own."""
        sig = signature(label, properties, "manual")
        old = self._t("nodes").where(F.col("unique_signature") == sig).first()
        if old is not None:
            self._rewrite(old["node_id"], old["node_label"], json.loads(old["node_properties"] or "{}") | properties)
            return old["node_id"]
        node_id = self._store.next_id("nodes", "node_id")
        row = self._store.spark.createDataFrame([(node_id, label, json.dumps(properties), sig)], "node_id long, node_label string, node_properties string, unique_signature string")
        self._store.append("nodes", self._embedded(row))
        return node_id

    def _rewrite(self, node_id: int, label: str, properties: dict) -> None:
        nodes = self._t("nodes")
        mine = nodes.where(F.col("node_id") == node_id).withColumns({"node_label": F.lit(label), "node_properties": F.lit(json.dumps(properties))})
        self._store.change(replace={"nodes": nodes.where(F.col("node_id") != node_id).unionByName(self._embedded(mine))})

    def get_node_details(self, node_id: int) -> dict | None:
        r = self._t("nodes").where(F.col("node_id") == node_id).first()
        return None if r is None else self._node(r)

    def _get(self, node_id: int) -> dict:
        found = self.get_node_details(node_id)
        if found is None:
            raise NodeNotFoundError(f"there is no node {node_id}")
        return found

    def get_nodes_by_label(self, label: str, limit: int = 100) -> list[dict]:
        return [self._node(r) for r in self._t("nodes").where(F.col("node_label") == label).orderBy("node_id").limit(limit).collect()]

    def find_similar_nodes_by_property(self, label: str, key: str, value: str, limit: int = 10) -> list[dict]:
        return [self._node(r) for r in holding(self._t("nodes"), label, key, value).orderBy("node_id").limit(limit).collect()]

    @changing
    def update_node(self, node_id: int, label: str | None = None, properties: dict | None = None) -> None:
        """New properties replace the old ones, but other_identifiers stay."""
        old = self._get(node_id)
        kept = {k: v for k, v in old["properties"].items() if k == "other_identifiers"}
        self._rewrite(node_id, label or old["label"], old["properties"] if properties is None else kept | properties)

    @changing
    def delete_node(self, node_id: int) -> None:
        self._get(node_id)
        self._remove(self._store.spark.createDataFrame([(node_id,)], "node_id long"))

    def _remove(self, gone: DataFrame) -> None:
        self._store.change(replace=self._without(gone))

    def _without(self, gone: DataFrame) -> dict[str, DataFrame]:
        r = self._t("relationships")
        for end in ("source_node_id", "target_node_id"):
            r = r.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
        return {"relationships": r} | {name: self._t(name).join(gone, "node_id", "left_anti") for name in ("nodes", "links")}

    @changing
    def merge_nodes(self, keep: int, drop: int) -> None:
        """Relationships and links of drop become those of keep."""
        self._get(keep), self._get(drop)
        swap = lambda c: F.when(F.col(c) == drop, F.lit(keep)).otherwise(F.col(c))
        r = self._t("relationships").withColumns({c: swap(c) for c in ("source_node_id", "target_node_id")})
        self._store.change(replace={"relationships": r, "links": self._t("links").withColumn("node_id", swap("node_id")).distinct(), "nodes": self._t("nodes").where(F.col("node_id") != drop)})

    # relationships

    @changing
    def add_relationship(self, source: int, target: int, kind: str, properties: dict | None = None) -> int:
        if self._t("nodes").where(F.col("node_id").isin(source, target)).count() < len({source, target}):
            raise GraphError(f"node {source} or {target} doesn't exist")
        n = self._store.next_id("relationships", "relationship_id")
        self._store.append("relationships", self._store.spark.createDataFrame([(n, source, target, kind, json.dumps(properties or {}))], "relationship_id long, source_node_id long, target_node_id long, relationship_type string, relationship_properties string"))
        return n

    def get_relationship(self, relationship_id: int) -> dict | None:
        r = self._t("relationships").where(F.col("relationship_id") == relationship_id).first()
        return None if r is None else self._edge(r)

    @changing
    def update_relationship(self, relationship_id: int, kind: str | None = None, properties: dict | None = None) -> None:
        old = self.get_relationship(relationship_id)
        if old is None:
            raise RelationshipNotFoundError(f"there is no relationship {relationship_id}")
        mine = F.col("relationship_id") == relationship_id
        new = {"relationship_type": kind or old["type"], "relationship_properties": json.dumps(old["properties"] if properties is None else properties)}
        self._store.change(replace={"relationships": self._t("relationships").withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in new.items()})})

    @changing
    def delete_relationship(self, relationship_id: int) -> None:
        if self.get_relationship(relationship_id) is None:
            raise RelationshipNotFoundError(f"there is no relationship {relationship_id}")
        self._store.change(replace={"relationships": self._t("relationships").where(F.col("relationship_id") != relationship_id)})

    def _near(self, node_id: int, kind: str | None, direction: str, limit: int) -> DataFrame:
        e = directed(self._t("relationships"), direction).where(F.col("at") == node_id)
        if kind:
            e = e.where(F.col("relationship_type") == kind)
        return e.orderBy("relationship_id").limit(limit)

    def get_relationships(self, node_id: int, relationship_type: str | None = None, direction: str = "any", limit: int = 50) -> list[dict]:
        near = self._near(node_id, relationship_type, direction, limit)
        return [self._edge(r) for r in near.orderBy("relationship_id").collect()]

    def find_neighbors(self, node_id: int, relationship_type: str | None = None, direction: str = "any", limit: int = 50) -> list[dict]:
        """The limit is on relationships; neighbours in order of the first that leads to them."""
        first = self._near(node_id, relationship_type, direction, limit).groupBy(F.col("to").alias("node_id")).agg(F.min("relationship_id").alias("_first"))
        return [self._node(r) for r in self._t("nodes").join(F.broadcast(first), "node_id").orderBy("_first").collect()]

    def get_chunks_for_node(self, node_id: int, limit: int = 10) -> list[dict]:
        links = self._t("links").where(F.col("node_id") == node_id).orderBy("chunk_id").limit(limit)
        return [{"chunk_id": r["chunk_id"], "chunk_text": r["chunk_text"], "file_path": r["file_path"]} for r in self._store.chunks().join(links, "chunk_id").orderBy("chunk_id").collect()]

    # all of it

    def get_all_nodes_for_visualization(self, limit: int = 1000) -> list[dict]:
        return [{"id": r["node_id"], "label": r["node_label"], "properties": (p := json.loads(r["node_properties"] or "{}")), "title": json.dumps(p, indent=2)} for r in self._t("nodes").orderBy("node_id").limit(limit).collect()]

    def get_all_relationships_for_visualization(self, limit: int = 2000) -> list[dict]:
        r = self._t("relationships").withColumn("label", edge_label(F.col("relationship_properties"), F.col("relationship_type")))
        return [{"id": x["relationship_id"], "from": x["source_node_id"], "to": x["target_node_id"], "label": x["label"], "properties": json.loads(x["relationship_properties"] or "{}")} for x in r.orderBy("relationship_id").limit(limit).collect()]

    @changing
    def clear_graph(self) -> None:
        chunks = self._t("chunks").withColumn("graph_processed_at", F.lit(None).cast("timestamp"))
        self._store.change(replace={"chunks": chunks} | {name: self._t(name).limit(0) for name in ("nodes", "relationships", "links")})

    def delete_all_graph_data(self) -> None:
        self._store.properties["graph_features_enabled"] = False
        self.clear_graph()

    @changing
    def remove_graph_elements_for_document(self, doc_id: int) -> None:
        """Nodes that only this document's chunks are linked to go; its chunks count as not processed."""
        gone = self._store._staged(exclusive_nodes(self._t("links"), self._t("chunks"), doc_id), "gone")
        frames = self._without(gone)
        stamp = F.when(F.col("doc_id") == doc_id, F.lit(None).cast("timestamp")).otherwise(F.col("graph_processed_at"))
        mine = self._t("chunks").where(F.col("doc_id") == doc_id).select("chunk_id")
        self._store.change(replace=frames | {"chunks": self._t("chunks").withColumn("graph_processed_at", stamp), "links": frames["links"].join(mine, "chunk_id", "left_anti")})
