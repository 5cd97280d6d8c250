"""Pages of a site: index, search, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaloom.functions import text as T

TEXT_MOST, ORDER_UNSET, HITS = 8000, 999, 8


def index(documents: DataFrame, path: str, text: str) -> DataFrame:
    """(source, title, url, page_order, text): one row by document.

    The text is cut to the index's length, which belongs to its form; the order is 999 where none is set.
    """
    c, p = T.unix_lines(F.col(text)), F.col(path)
    order = F.coalesce(F.expr("try_cast(_order as int)"), F.lit(ORDER_UNSET))
    return (
        documents.withColumn("_order", T.front_value(c, "order"))
        .select(p.alias("source"), T.page_title(c, p).alias("title"), T.output_path(p, "html").alias("url"), order.alias("page_order"), F.substring(T.without_fences(T.text_or_empty(c)), 1, TEXT_MOST).alias("text"))
    )


def search(pages: DataFrame, query: str, k: int = HITS) -> DataFrame:
    """The first k pages, in the index's order, whose title or text holds the query, whatever its case; of a page that comes twice the first."""
    held = F.contains(F.lower(F.concat_ws(" ", "title", "text")), F.lit(query.lower()))
    first = F.min(F.struct("page_order", "title", "url", "text")).alias("p")
    once = pages.groupBy("source").agg(first).select("source", "p.*")
    return once.filter(held).orderBy("page_order", "title", "source").limit(k).select("source", "title", "url", "page_order")
