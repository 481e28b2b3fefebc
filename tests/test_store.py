import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.errors import ConcurrencyError, ConfigurationError, FileHandlingError, PageNotFoundError, QueryError
from docquarry.functions import security
from docquarry.operators import graph, search, sparql
from docquarry.operators.graph import GraphStore
from docquarry.plans.store import Store, metadata_prefix
from docquarry.sources import parsers
from docquarry.streaming.ingest import watch_files


def test_documents_come_change_and_go(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("This is the first sentence.\nThis is the second sentence.\nAnd a third.")
    with Store(spark, str(tmp_path / "store"), chunking_strategy="character", chunk_size=30, chunk_overlap=5) as st:
        first = st.add_document(str(f), metadata={"topic_name": "x"}, tags=["b", "a", "b"])
        assert first["num_chunks_added"] > 1
        assert st.add_document(str(f)) == {"num_chunks_added": 0, "num_chunks_ignored": 0}
        ids = {d["file_path"]: d["doc_id"] for d in st.list_documents()}
        f.write_text("This is completely new content.\nWith two lines.")
        assert st.add_document(str(f))["num_chunks_added"] == 2
        assert {d["file_path"]: d["doc_id"] for d in st.list_documents()} == ids
        assert st.add_text("note", "Another document.\nWith different content for testing.")["num_chunks_added"] == 2
        assert len(st.list_documents()) == 2
        assert st.table("chunks").count() == st.table("vectors").count() == 4
        hit = st.query("different content for testing", top_k=1)[0]
        assert hit["file_path"] == "note" and 0 <= hit["similarity_percent"] <= 100
        assert st.get_chunk_by_id(hit["chunk_id"])["file_path"] == "note" and st.get_chunk_by_id(999) is None
        assert st.reconstruct_document_text("note").startswith("Another document.") and st.reconstruct_document_text("none") is None
        assert len(st.export_point_cloud("dict")) == 4 and json.loads(st.export_point_cloud()) and st.export_point_cloud("csv").startswith("x,y,")
        st.delete_document_by_path("note")
        st.delete_document_by_id(77)
        assert len(st.list_documents()) == 1 and st.table("vectors").count() == 2
        with pytest.raises(FileHandlingError):
            st.add_document(str(tmp_path / "none.txt"))
        bad = tmp_path / "b.xyz"
        bad.write_text("x")
        with pytest.raises(ConfigurationError):
            st.add_document(str(bad))
    with pytest.raises(ConfigurationError):
        Store(spark, str(tmp_path / "store"), vectorizer="hashing", vectorizer_config={"dim": 8})


def test_ingest_statuses_and_empty_texts(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as st:
        rows = spark.createDataFrame([("a", "one two"), ("a", "one two"), ("b", "  "), ("c", None)], "file_path string, text string")
        got = {r.file_path: r.status for r in st.ingest(rows).collect()}
        assert got == {"a": "new", "b": "empty", "c": "error"}
        again = spark.createDataFrame([("a", "one two"), ("b", "now text")], "file_path string, text string")
        assert {r.file_path: r.status for r in st.ingest(again).collect()} == {"a": "unchanged", "b": "changed"}
        assert {r.file_path: r.status for r in st.ingest(again, force=True).collect()} == {"a": "forced", "b": "forced"}
        assert st.table("documents").count() == 2
        assert st.ingest(again.limit(0)).count() == 0
        assert st.add_text("w", "some words here", skip_chunking=True)["num_chunks_added"] == 1


def test_second_writer_fails(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    manifest = st._manifest()
    st.change()
    with pytest.raises(ConcurrencyError):
        st._commit(manifest["version"], manifest["tables"])


def test_encrypted_store(spark, tmp_path):
    text = "This text should be encrypted.\nIt has multiple lines."
    options = {"chunking_strategy": "character", "chunk_size": 30, "chunk_overlap": 5}
    with Store(spark, str(tmp_path / "s"), password="pw", **options) as st:
        st.add_text("t", text, metadata={"k": "v"})
        stored = st.table("chunks").orderBy("chunk_seq").collect()
        assert all(r.is_encrypted and text.encode()[:10] not in bytes(r.chunk_text) for r in stored)
        assert [r.chunk_text for r in st.chunks().orderBy("chunk_seq").collect()] == ["This text should be encrypted.", "pted.\nIt has multiple lines."]
        assert st.list_documents()[0]["metadata"] == {"k": "v"}
    assert Store(spark, str(tmp_path / "s"), **options).chunks().first().chunk_text == security.KEY_MISSING
    other = Store(spark, str(tmp_path / "s"), password="other", **options)
    assert other.chunks().first().chunk_text == security.NOT_DECRYPTED and other.query("x")[0]["document_metadata"]["error"]


def test_prefix_and_tfidf(spark, tmp_path):
    assert metadata_prefix({"topic_name": "A", "n": 1}) == "--- Document Context ---\nTopic_Name: A\nN: 1\n------------------------\n\n"
    with Store(spark, str(tmp_path / "s"), vectorizer="tf_idf") as st:
        st.add_text("a", "apples and pears")
        st.add_text("b", "pears and plums")
        assert st.query("apples", 1)[0]["file_path"] == "a"
    with Store(spark, str(tmp_path / "s"), vectorizer="tf_idf") as st:
        assert st.query("apples", 1)[0]["file_path"] == "a"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha beta")
    with Store(spark, str(tmp_path / "s")) as st:
        for n in (1, 2):
            watch_files(st, str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination(120)
            assert st.table("documents").count() == n
            (tmp_path / "in" / "b.txt").write_text("gamma delta")


def test_parsers(spark, tmp_path):
    assert parsers.parse_bytes("a.json", b'{"b": 1, "a": "\xc3\xa9"}') == '{\n  "b": 1,\n  "a": "é"\n}'
    assert parsers.parse_bytes("a.csv", b"n,v\n10,2\n3, \n") == "Row 1: n=10 | v=2\nRow 2: n=3"
    assert parsers.parse_bytes("a.html", b"<title>T</title><script>x</script><p> This is <b>HTML</b> content.</p>") == "T\nThis is\nHTML\ncontent."
    assert parsers.parse_bytes("a.txt", b"a\r\nb") == "a\nb"
    for name, data in (("a.txt", b"\xff"), ("a.json", b"{"), ("a.docx", b"x")):
        with pytest.raises(parsers.ParsingError):
            parsers.parse_bytes(name, data)
    assert parsers.attachment_text("a.txt", b"x" * 400).endswith("x...") and "400 bytes" in parsers.attachment_text("a.bin", b"x" * 400)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("hello")
    (tmp_path / "d" / "b.xyz").write_text("hello")
    got = {r.file_path[-4:]: (r.text, r.error is None) for r in parsers.read_files(spark, str(tmp_path / "d")).collect()}
    assert got == {"a.md": ("hello", True), ".xyz": (None, False)}


def test_pages(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as st:
        p = st.pages
        p.import_markdown_as_tree(1, "lost\n# A\ntext\n### B\nmore\n## C\n# D\n")
        tree = p.get_tree(1)
        assert [(n["title"], [c["title"] for c in n["children"]]) for n in tree] == [("A", ["B", "C"]), ("D", [])]
        assert tree[0]["content"] == "text\n" and tree[0]["children"][0]["level"] == 1
        b = tree[0]["children"][0]["page_id"]
        child = p.add_page(1, "E", parent_id=b)
        assert [t for _, t in p.get_breadcrumbs(child)] == ["A", "B", "E"]
        assert [c["title"] for c in p.get_children(b)] == ["E"]
        p.import_csv_as_flat_list(2, "name,v\nx,1\n,2\n", "name")
        assert [n["title"] for n in p.get_tree(2)] == ["x", "Row 1"]
        with pytest.raises(PageNotFoundError):
            p.get_page(999)


def llm(prompt):
    if "How should the graph" in prompt:
        return "no json"
    return """```json
    {"nodes": [{"label": "Person", "properties": {"name": "Ada"}}, {"label": "City", "properties": {"name": "London"}}, {"label": "bad"}],
     "relationships": [{"source_node_label": "Person", "source_node_identifying_value": "ada", "target_node_label": "City", "target_node_identifying_value": "London", "type": "LIVES_IN", "properties": {"name": "lives"}},
                       {"source_node_label": "Person", "source_node_identifying_value": "nobody", "target_node_label": "City", "target_node_identifying_value": "London", "type": "LIVES_IN"}],}
    ```"""


def test_graph(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as st:
        st.add_text("a", "Ada lives in London.", skip_chunking=True)
        st.add_text("b", "Ada again.", skip_chunking=True)
        g = GraphStore(st, llm)
        assert g.build_graph_for_all_documents() == 2 and g.build_graph_for_all_documents() == 0
        assert st.table("nodes").count() == 2 and st.table("links").count() == 4 and st.table("relationships").count() == 2
        ada = g.get_nodes_by_label("Person")[0]["node_id"]
        london = g.find_neighbors(ada, direction="outgoing")
        assert [n["properties"]["name"] for n in london] == ["London"] and g.find_neighbors(ada, direction="incoming") == []
        with pytest.raises(ValueError):
            g.find_neighbors(ada, direction="sideways")
        assert g.query_sparql('ASK { "ada" <LIVES_IN> <City> }') == {"boolean": True}
        assert g.query_sparql("SELECT ?x WHERE { ?x <LIVES_IN> ?y }")["results"]["bindings"] == [{"x": {"type": "uri", "value": "Person"}}]
        assert g.query_sparql("DESCRIBE <City>") == {"graph": [("Person", "LIVES_IN", "City")]}
        with pytest.raises(QueryError):
            g.query_sparql("SELECT nothing")
        full = g.query_graph("Person Ada", "full", 1, 1)
        assert len(full["graph"]["nodes"]) == 2 and len(full["chunks"]) == 2
        new = g.add_node("Person", {"name": "Eve"})
        assert g.add_node("Person", {"name": "Eve", "age": 3}) == new and g.get_node_details(new)["properties"] == {"name": "Eve", "age": 3}
        r = g.add_relationship(new, ada, "KNOWS")
        g.update_relationship(r, properties={"since": 1})
        assert g.get_relationship(r)["properties"] == {"since": 1} and g.get_relationships(new)[0]["type"] == "KNOWS"
        g.update_node(new, properties={"name": "Eva"})
        assert g.get_node_details(new)["properties"] == {"name": "Eva"}
        g.merge_nodes(ada, new)
        assert g.get_node_details(new) is None and g.get_relationship(r)["source_node_id"] == ada
        assert g.get_all_relationships_for_visualization()[0]["label"] == "lives" and len(g.get_all_nodes_for_visualization()) == 2
        assert len(g.get_chunks_for_node(ada)) == 2
        g.delete_relationship(r)
        g.delete_node(ada)
        assert st.table("relationships").count() == 0
        g.remove_graph_elements_for_document(1)
        assert st.table("links").count() == 1
        g.clear_graph()
        assert st.table("nodes").count() == 0 and g.build_graph_for_all_documents() == 2


def test_expansion_passes_cycles_and_label_filter(spark):
    nodes = spark.createDataFrame([(k, "A" if k != 3 else "B", "{}") for k in range(1, 6)], "node_id long, node_label string, node_properties string")
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (2, 2), (4, 5)]
    rel = spark.createDataFrame([(k, a, b, "R", "{}") for k, (a, b) in enumerate(pairs)], "relationship_id long, source_node_id long, target_node_id long, relationship_type string, relationship_properties string")
    seeds = nodes.where("node_id = 1").select("node_id")
    reached, passed = graph.expand(nodes, rel, seeds, 5)
    assert {(r.node_id, r.depth) for r in reached.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    reached, passed = graph.expand(nodes, rel, seeds, 5, labels=["A"])
    assert {r.node_id for r in reached.collect()} == {1, 2} and 2 in {r.relationship_id for r in passed.collect()}


def test_sparql_joins_shared_variables(spark):
    nodes = spark.createDataFrame([(1, "X", '{"name":"a.b"}'), (2, "Y", "{}"), (3, "Z", "{}")], "node_id long, node_label string, node_properties string")
    rel = spark.createDataFrame([(1, 1, 2, "R", "{}"), (2, 2, 3, "S", "{}")], "relationship_id long, source_node_id long, target_node_id long, relationship_type string, relationship_properties string")
    got = sparql.run('SELECT ?a ?c WHERE { ?a <R> ?b . ?b ?p ?c . "a.b" <R> ?b }', nodes, rel)
    assert got["results"]["bindings"] == [] or [(b["a"]["value"], b["c"]["value"]) for b in got["results"]["bindings"]] == [("X", "Z")]
    assert sparql.run("CONSTRUCT { ?a <R> ?b } WHERE { ?a <R> ?b }", nodes, rel) == {"graph": [("X", "R", "Y")]}
    for bad in ("SELECT ?x WHERE { ?y <R> ?z }", "SELECT ?x { ?x <R> }", "DROP ?x", "SELECT ?x { ?x <R> ?y . FILTER(?x) }"):
        with pytest.raises(QueryError):
            sparql.run(bad, nodes, rel)


def test_point_cloud_equals_svd(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 6)) * [5, 3, 1, 1, 1, 1] + 2
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "k int, embedding array<float>")
    got = np.array([(r.x, r.y) for r in search.point_cloud(df).orderBy("k").collect()])
    c = m.astype(np.float32).astype(float)
    c -= c.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs(c @ vt[:2].T), atol=1e-4)


def test_top_k_many_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 4)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in search.top_k_many(df, df.withColumnRenamed("vec_id", "query_id"), 3, key="vec_id").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    n = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(n @ n.T, 12)
    for q in range(60):
        assert [got[q][k] for k in (1, 2, 3)] == sorted(range(60), key=lambda k: (-s[q, k], -k))[:3]
    assert search.top_k(df, m[0].tolist(), 0, 0, key="vec_id").where(F.col("vec_id") == 0).first().similarity_percent == 100


def test_top_k_many_of_one_partition_is_dealt_to_tasks_and_exact(spark):
    rng = np.random.default_rng(2)
    m = (rng.normal(size=(1, 8)) + rng.normal(size=(2500, 8)) * 1e-6).astype(np.float32)  # nearer than single precision tells
    m[900:1000] = m[5]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>").coalesce(1)
    found = search.top_k_many(df, df.where("vec_id % 500 = 5").withColumnRenamed("vec_id", "query_id"), 3, key="vec_id")
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    d = m.astype(float)
    dot = lambda a, b: (a * b).cumsum(axis=-1)[..., -1]
    want = set()
    for q in range(5, 2500, 500):
        s = np.clip(dot(d, d[q]) / (np.sqrt(dot(d, d)) * np.sqrt(dot(d[q], d[q]))), -1, 1)
        want |= {(q, int(v), n) for n, v in enumerate(np.lexsort((-np.arange(2500), -s))[:3], 1)}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == want


def test_a_commit_between_reading_and_writing_is_not_lost(spark, tmp_path):
    path = str(tmp_path / "s")
    st, other = Store(spark, path), Store(spark, path)
    st.add_text("a", "the first text")
    raced = []

    def slow(text, metadata):
        return text

    numbered = st._numbered

    def late(*args):
        if not raced:  # another writer commits after this one has read its tables
            raced.append(other.add_text("b", "a text of another writer"))
        return numbered(*args)

    st._numbered = late
    st.add_text("c", "a text that comes late")
    assert {d["file_path"] for d in st.list_documents()} == {"a", "b", "c"} and raced
    ids = [r.doc_id for r in st.table("documents").collect()]
    assert len(ids) == len(set(ids)) and st.table("chunks").select("chunk_id").distinct().count() == st.table("vectors").count() == 3
    with st.transaction():
        stale = st.table("documents")
        other.add_text("d", "meanwhile")
        with pytest.raises(ConcurrencyError):
            st.change(replace={"documents": stale})
    assert len(st.list_documents()) == 4
    assert st.vacuum(0) > 0 and len(st.list_documents()) == 4 and st.vacuum(0) == 0


def test_claims_of_dead_writers_go(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"), lock_timeout=0.5)
    n = st._manifest()["version"]
    open(tmp_path / "s" / "manifests" / f"{n + 1:012d}.claim", "w").close()
    assert st.table("documents").count() == 0  # readers don't mind
    import time

    time.sleep(1)
    st.lock_timeout = 0.9
    assert st.add_text("a", "text after a crash")["num_chunks_added"] == 1


def test_secrets_are_not_stored(spark, tmp_path):
    from docquarry.operators.vectorizers import unique_name

    assert unique_name("openai", {"model": "m", "api_key": "one"}) == unique_name("openai", {"model": "m", "api_key": "two"})
    Store(spark, str(tmp_path / "s"), vectorizer="hashing", vectorizer_config={"dim": 16}).close()
    assert not any("api_key" in p.read_text() for p in (tmp_path / "s" / "manifests").glob("*.json"))


def test_relationships_are_passed_by_type_and_direction(spark):
    nodes = spark.createDataFrame([(k, "A", "{}") for k in range(1, 7)], "node_id long, node_label string, node_properties string")
    rel = spark.createDataFrame([(k, a, b, t, "{}") for k, (a, b, t) in enumerate([(1, 2, "R"), (3, 1, "R"), (1, 4, "S"), (5, 1, "S"), (1, 6, "T")])], "relationship_id long, source_node_id long, target_node_id long, relationship_type string, relationship_properties string")
    seeds = nodes.where("node_id = 1").select("node_id")
    reach = lambda *specs, **kw: {r.node_id for r in graph.expand(nodes, rel, seeds, 1, list(specs), **kw)[0].collect()} - {1}
    assert reach({"type": "R", "direction": "outgoing"}, {"type": "S", "direction": "incoming"}) == {2, 5}
    assert reach("R", {"type": "T", "direction": "incoming"}) == {2, 3} and reach() == {2, 3, 4, 5, 6}
    assert reach("R", "S", fan=1) == {2, 4}  # one of each kind
    with pytest.raises(ValueError):
        reach({"type": "R", "direction": "sideways"})
