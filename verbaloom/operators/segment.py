"""Documents to ordered, typed segments with stable ids.

Two levels of the grammar. ``segments`` parses whole documents (nested lists and quotes, tables, components)
in Arrow batches: one row in, its segments out, no shuffle. ``line_blocks`` is the flat grammar of lines as
one native plan: lines, a running parity of fences, islands of equal lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.functions import text as T
from verbaloom.operators.blocks import blocks

TRANSLATABLE = ("heading", "paragraph", "list_item", "blockquote", "table_cell", "image_alt", "link_text", "admonition_title", "admonition_body", "jsx_prop", "jsx_child")


def segments(documents: DataFrame, path: str, text: str, strict: bool = False) -> DataFrame:
    """(doc_path, ord, kind, idx, src_text, frozen, meta, id, fingerprint, status).

    Null paths are kept as they are; null and blank texts give no rows. Extra columns are not read.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, body in zip(pdf.doc_path, pdf.body, strict=True):
                count: dict[str, int] = {}
                for n, b in enumerate(blocks(body, strict)):
                    k = count.get(b.kind, 0)
                    count[b.kind] = k + 1
                    rows.append((doc, n, b.kind, k, b.text, b.frozen, b.meta))
            yield pd.DataFrame(rows, columns=["doc_path", "ord", "kind", "idx", "src_text", "frozen", "meta"])

    raw = documents.select(F.col(path).cast("string").alias("doc_path"), F.col(text).alias("body"))
    out = raw.mapInPandas(parse, "doc_path string, ord int, kind string, idx int, src_text string, frozen boolean, meta map<string,string>")
    return out.withColumns({
        "id": T.segment_id(F.coalesce("doc_path", F.lit("")), F.col("kind"), F.col("idx"), F.col("src_text")),
        "fingerprint": T.fingerprint(F.col("src_text")),
        "status": F.lit("new"),
    })


def document_ir(segs: DataFrame) -> DataFrame:
    """(doc_path, nodes): the ordered nodes of each document as one nested row."""
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "kind", "frozen", "meta"))), lambda n: F.struct(n["id"].alias("id"), n["kind"].alias("kind"), n["frozen"].alias("frozen"), n["meta"].alias("meta")))
    # A map can't be compared, so it travels as JSON while the nodes are put in order.
    safe = segs.withColumn("meta", F.to_json("meta"))
    return safe.groupBy("doc_path").agg(nodes.alias("nodes"))


def lines(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, line) of the body, without front matter; blank documents give their blank lines."""
    body = T.body(T.unix_lines(F.col(text)))
    return documents.select(F.col(doc).alias("doc"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))


def line_blocks(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, kind, idx, pos, src_text): the flat grammar, one shuffle by document for all its windows."""
    w = Window.partitionBy("doc").orderBy("pos")
    line = F.col("line")
    typed = (
        lines(documents, doc, text)
        .withColumn("fence", line.rlike(r"^ {0,3}```").cast("int"))
        .withColumn("fences", F.sum("fence").over(w))
        .withColumn(
            "kind",
            F.when(F.col("fence") == 1, "fence")
            .when(F.col("fences") % 2 == 1, "code_block")
            .when(F.trim(line) == "", "blank")
            .when(line.rlike(r"^#{1,6}\s+\S"), "heading")
            .when(line.rlike(r"^:::"), "fence")
            .when(line.rlike(r"^>"), "blockquote")
            .when(line.rlike(r"^([-*+]|\d+[.)])\s+\S"), "list_item")
            .when(line.rlike(r"^\|"), "table_row")
            .otherwise("paragraph"),
        )
    )
    starts = F.when((F.lag("kind").over(w) == F.col("kind")) & ~F.col("kind").isin("heading", "list_item", "table_row"), 0).otherwise(1)
    grouped = typed.withColumn("start", starts).withColumn("island", F.sum("start").over(w)).filter("kind not in ('blank', 'fence')")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    made = grouped.groupBy("doc", "island", "kind").agg(F.min("pos").alias("pos"), joined.alias("src_text"))
    return made.withColumn("idx", F.row_number().over(Window.partitionBy("doc", "kind").orderBy("pos")) - 1).select("doc", "kind", "idx", "pos", "src_text")


def translatable(segs: DataFrame) -> DataFrame:
    return segs.filter(~F.coalesce("frozen", F.lit(False)) & F.col("kind").isin(*TRANSLATABLE))
