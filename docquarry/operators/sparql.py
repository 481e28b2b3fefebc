"""A subset of SPARQL over nodes and relationships, compiled to DataFrame joins.

SELECT, ASK, CONSTRUCT and DESCRIBE over a basic graph pattern.  A node IRI stands for the nodes of that label, a
literal for those whose properties hold that text, in any case; a predicate IRI is a relationship type, a predicate
literal a text within the relationship's properties.  A variable shared by two places is the same node
(or the same type); it is shown as the node's label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.errors import QueryError

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^>\s]*>)|(?P<literal>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<variable>[?$]\w+)|(?P<sign>[{}.*;,])|(?P<word>[^\s{}<>"'?]+?(?=[\s{}.;,]|$))""")


@dataclass(frozen=True)
class Term:
    kind: str  # variable, uri or literal
    value: str


@dataclass(frozen=True)
class Query:
    form: str
    variables: tuple[str, ...]
    patterns: tuple[tuple[Term, Term, Term], ...]
    resources: tuple[Term, ...] = ()


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def _term(kind: str, value: str) -> Term:
    if kind == "variable":
        return Term("variable", value[1:])
    if kind == "iri":
        return Term("uri", value[1:-1])
    if kind == "literal":
        return Term("literal", re.sub(r"\\(.)", r"\1", value[1:-1]))
    return Term("literal", value)


def parse(text: str) -> Query:
    tokens = _tokens(text)
    if not tokens or tokens[0][0] != "word":
        raise QueryError("a query begins with SELECT, ASK, CONSTRUCT or DESCRIBE")
    form = tokens[0][1].upper()
    if form not in ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE"):
        raise QueryError(f"unsupported form of query: {form}")
    for kind, value in tokens:
        if kind == "word" and value.upper() in ("FILTER", "OPTIONAL", "UNION", "PREFIX", "ORDER", "LIMIT", "GROUP", "GRAPH", "MINUS", "BIND"):
            raise QueryError(f"{value.upper()} isn't supported")
    opens = [k for k, t in enumerate(tokens) if t == ("sign", "{")]
    head = tokens[1 : opens[-1] if opens else len(tokens)]
    resources = tuple(_term(*t) for t in head if t[0] in ("iri", "literal")) if form == "DESCRIBE" else ()
    if not opens:
        if form != "DESCRIBE" or not resources:
            raise QueryError("the query has no pattern in braces")
        return Query(form, (), (), resources)
    close = next((k for k in range(opens[-1], len(tokens)) if tokens[k] == ("sign", "}")), None)
    if close is None:
        raise QueryError("the pattern's brace isn't closed")
    patterns, held = [], []
    for t in [*tokens[opens[-1] + 1 : close], ("sign", ".")]:
        if t == ("sign", "."):
            if held and len(held) != 3:
                raise QueryError(f"a triple has three parts, not {len(held)}")
            if held:
                patterns.append(tuple(held))
            held = []
        elif t[0] == "sign":
            raise QueryError(f"{t[1]} isn't supported within a pattern")
        else:
            held.append(_term(*t))
    if not patterns:
        raise QueryError("the pattern is empty")
    named = tuple(dict.fromkeys(v[1:] for k, v in head if k == "variable"))
    everything = tuple(dict.fromkeys(t.value for p in patterns for t in p if t.kind == "variable"))
    if form == "SELECT" and not named:
        if ("sign", "*") not in head:
            raise QueryError("SELECT names no variable")
        named = everything
    if missing := set(named) - set(everything):
        raise QueryError(f"not in the pattern: {', '.join(sorted(missing))}")
    return Query(form, named, tuple(patterns), resources)


def edges(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    n = nodes.select("node_id", "node_label", "node_properties")
    s = n.select(F.col("node_id").alias("source_node_id"), F.col("node_label").alias("s_label"), F.col("node_properties").alias("s_props"))
    t = n.select(F.col("node_id").alias("target_node_id"), F.col("node_label").alias("t_label"), F.col("node_properties").alias("t_props"))
    return relationships.join(s, "source_node_id").join(t, "target_node_id")


def _holds(column: str, text: str):
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(text.lower()))


def solve(query: Query, all_edges: DataFrame) -> DataFrame:
    """Distinct solutions: id and label columns of each node variable (n_x, l_x), l_x only of predicate variables, and each pattern's type (p_k) and labels."""
    roles: dict[str, str] = {}
    for s, p, o in query.patterns:
        for term, role in ((s, "node"), (p, "type"), (o, "node")):
            if term.kind == "variable" and roles.setdefault(term.value, role) != role:
                raise QueryError(f"?{term.value} is both a node and a predicate")
    solution: DataFrame | None = None
    for k, (s, p, o) in enumerate(query.patterns):
        e = all_edges
        for term, side in ((s, "s"), (o, "t")):
            if term.kind == "uri":
                e = e.where(F.col(f"{side}_label") == term.value)
            elif term.kind == "literal":
                e = e.where(_holds(f"{side}_props", term.value))
        if p.kind == "uri":
            e = e.where(F.col("relationship_type") == p.value)
        elif p.kind == "literal":
            e = e.where(_holds("relationship_properties", p.value))
        columns = {f"sl_{k}": F.col("s_label"), f"p_{k}": F.col("relationship_type"), f"tl_{k}": F.col("t_label")}
        if s.kind == "variable":
            columns |= {f"n_{s.value}": F.col("source_node_id"), f"l_{s.value}": F.col("s_label")}
        if o.kind == "variable":
            if s == o:
                e = e.where(F.col("source_node_id") == F.col("target_node_id"))
            columns |= {f"n_{o.value}": F.col("target_node_id"), f"l_{o.value}": F.col("t_label")}
        if p.kind == "variable":
            columns[f"l_{p.value}"] = F.col("relationship_type")
        e = e.select(*[c.alias(name) for name, c in columns.items()]).distinct()
        if solution is None:
            solution = e
        else:
            shared = [c for c in e.columns if c in solution.columns]
            solution = solution.join(e, shared) if shared else solution.crossJoin(e)
    return solution


def select(query: Query, all_edges: DataFrame) -> DataFrame:
    found = solve(query, all_edges)
    ids = [f"n_{v}" for v in query.variables if f"n_{v}" in found.columns]
    return found.select(*[F.col(f"l_{v}").alias(v) for v in query.variables], *ids).distinct()


def construct(query: Query, all_edges: DataFrame) -> DataFrame:
    """(subject, predicate, object) of all patterns in all solutions."""
    found = solve(query, all_edges)
    parts = [found.select(F.col(f"sl_{k}").alias("subject"), F.col(f"p_{k}").alias("predicate"), F.col(f"tl_{k}").alias("object")) for k in range(len(query.patterns))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def describe(query: Query, all_edges: DataFrame) -> DataFrame:
    """(subject, predicate, object) of all relationships from or to nodes of the labels asked for."""
    labels = [t.value for t in query.resources]
    if not labels:
        labels = [t.value for p in query.patterns for t in (p[0], p[2]) if t.kind == "uri"]
    if not labels:
        raise QueryError("DESCRIBE names no resource")
    return all_edges.where(F.col("s_label").isin(labels) | F.col("t_label").isin(labels)).select(F.col("s_label").alias("subject"), F.col("relationship_type").alias("predicate"), F.col("t_label").alias("object")).distinct()


def run(text: str, nodes: DataFrame, relationships: DataFrame) -> dict:
    query = parse(text)
    e = edges(nodes, relationships)
    if query.form == "ASK":
        return {"boolean": not solve(query, e).isEmpty()}
    if query.form == "SELECT":
        found = solve(query, e)
        kinds = {v: "uri" for v in query.variables if f"n_{v}" in found.columns}
        rows = select(query, e).drop(*[f"n_{v}" for v in query.variables]).distinct().collect()
        return {"head": {"vars": list(query.variables)}, "results": {"bindings": [{v: {"type": kinds.get(v, "literal"), "value": r[v]} for v in query.variables} for r in rows]}}
    triples = (construct if query.form == "CONSTRUCT" else describe)(query, e)
    return {"graph": [tuple(r) for r in triples.collect()]}
