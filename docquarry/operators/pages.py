"""Page trees: an adjacency list, read with recursive queries."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.errors import PageNotFoundError
from docquarry.plans.transactions import changing

SCHEMA = "page_id long, doc_id long, parent_id long, title string, content string, level int, page_order int, metadata string"
_HEADER = re.compile(r"(#+)\s+(.*)")


def markdown_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """SCHEMA, pages of the Markdown text of each doc_id.  page_id counts within the document.

    Text before the first header belongs to no page; a header's parent is the nearest one before it of smaller level.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column(text).to_pylist(), strict=True):
                pages: list[dict] = []
                above: list[tuple[int, dict]] = []
                for line in (body or "").split("\n"):
                    if m := _HEADER.match(line):
                        depth = len(m[1])
                        while above and above[-1][0] >= depth:
                            above.pop()
                        page = {"page_id": len(pages), "doc_id": doc, "parent_id": above[-1][1]["page_id"] if above else None, "title": m[2].strip(), "content": "", "level": above[-1][1]["level"] + 1 if above else 0, "page_order": len(pages), "metadata": None}
                        pages.append(page)
                        above.append((depth, page))
                    elif pages:
                        pages[-1]["content"] += line + "\n"
                rows += pages
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("page_id", pa.int64()), ("doc_id", pa.int64()), ("parent_id", pa.int64()), ("title", pa.string()), ("content", pa.string()), ("level", pa.int32()), ("page_order", pa.int32()), ("metadata", pa.string())])


def children(pages: DataFrame) -> DataFrame:
    """pages below another one, with rank: their place among those of the same parent, by page_order, then page_id."""
    return pages.where("parent_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("parent_id").orderBy("page_order", "page_id")))


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """(page_id, depth, ancestor_id, title): the pages from each page (depth 0) up to its root."""
    pages.select("page_id", "parent_id", "title").createOrReplaceTempView("_crumb_pages")
    return pages.sparkSession.sql(
        """WITH RECURSIVE up(page_id, ancestor_id, depth, title, parent_id) AS (
             SELECT page_id, page_id, 0, title, parent_id FROM _crumb_pages
             UNION ALL SELECT u.page_id, p.page_id, u.depth + 1, p.title, p.parent_id FROM up u JOIN _crumb_pages p ON p.page_id = u.parent_id)
           SELECT page_id, depth, ancestor_id, title FROM up"""
    )


def tree(pages: DataFrame) -> DataFrame:
    """(page_id, depth, path): all pages in the tree, path being the orders from the root down, to sort by."""
    pages.select("page_id", "parent_id", "page_order").createOrReplaceTempView("_tree_pages")
    return pages.sparkSession.sql(
        """WITH RECURSIVE down(page_id, depth, path) AS (
             SELECT page_id, 0, array(page_order) FROM _tree_pages WHERE parent_id IS NULL
             UNION ALL SELECT p.page_id, d.depth + 1, concat(d.path, array(p.page_order)) FROM down d JOIN _tree_pages p ON p.parent_id = d.page_id)
           SELECT page_id, depth, path FROM down"""
    )


class PageIndex:
    """Pages of a store; tables are read and written through it."""

    def __init__(self, store):
        self._store = store

    def _pages(self) -> DataFrame:
        return self._store.table("pages")

    @changing
    def add_page(self, doc_id: int, title: str, content: str = "", parent_id: int | None = None, page_order: int = 0, metadata: dict | None = None) -> int:
        level = 0 if parent_id is None else self.get_page(parent_id)["level"] + 1
        page_id = self._store.next_id("pages", "page_id")
        row = (page_id, doc_id, parent_id, title, content, level, page_order, json.dumps(metadata) if metadata is not None else None)
        self._store.append("pages", self._store.spark.createDataFrame([row], SCHEMA))
        return page_id

    def get_page(self, page_id: int) -> dict:
        row = self._pages().where(F.col("page_id") == page_id).first()
        if row is None:
            raise PageNotFoundError(f"there is no page {page_id}")
        return row.asDict()

    def get_children(self, parent_id: int) -> list[dict]:
        return [r.asDict() for r in children(self._pages().where(F.col("parent_id") == parent_id)).orderBy("rank").drop("rank").collect()]

    def get_breadcrumbs(self, page_id: int) -> list[tuple[int, str]]:
        up = breadcrumbs(self._pages()).where(F.col("page_id") == page_id).orderBy(F.desc("depth"))
        return [(r["ancestor_id"], r["title"]) for r in up.collect()]

    def get_tree(self, doc_id: int, parent_id: int | None = None) -> list[dict]:
        rows = [r.asDict() | {"children": []} for r in self._pages().where(F.col("doc_id") == doc_id).orderBy("page_order", "page_id").collect()]
        by_id = {r["page_id"]: r for r in rows}
        for r in rows:
            if r["parent_id"] in by_id:
                by_id[r["parent_id"]]["children"].append(r)
        return [r for r in rows if r["parent_id"] == parent_id]

    @changing
    def _import(self, pages: DataFrame) -> None:
        first = self._store.next_id("pages", "page_id")
        shift = F.lit(first)
        self._store.append("pages", pages.withColumns({"page_id": F.col("page_id") + shift, "parent_id": F.col("parent_id") + shift}))

    def import_markdown_as_tree(self, doc_id: int, markdown: str) -> None:
        self._import(markdown_pages(self._store.spark.createDataFrame([(doc_id, markdown)], "doc_id long, text string")))

    def import_csv_as_flat_list(self, doc_id: int, csv_text: str, title_col: str | None = None) -> None:
        import csv
        import io

        rows = list(csv.DictReader(io.StringIO(csv_text)))
        pages = [(k, doc_id, None, (r.get(title_col) if title_col else None) or f"Row {k}", json.dumps(r, indent=2), 0, k, '{"type": "csv_row"}') for k, r in enumerate(rows)]
        self._import(self._store.spark.createDataFrame(pages, SCHEMA))
