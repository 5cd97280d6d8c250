"""What the queries share: a register, the tables with repeated deliveries counted once, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbaloom.operators.catalogue import latest
from verbaloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the same in DuckDB's SQL where there is one."""

    def take(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return take


def _of(df: DataFrame, columns: str, *always: str) -> DataFrame:
    return df.select(*dict.fromkeys([*always[:1], *columns.split(), *always[1:]])) if columns else df


def catalogue(spark: SparkSession, base: str, columns: str = "") -> DataFrame:
    """columns: the ones a query needs, so the scan reads no others."""
    return latest(_of(table(spark, base, "demo"), columns, "pair_id", "extracted_at"), ["pair_id"], ["extracted_at"])


def memory(spark: SparkSession, base: str, columns: str = "") -> DataFrame:
    return latest(_of(table(spark, base, "tm_entries"), columns, "entry_id", "ingested_at"), ["entry_id"], ["ingested_at"])


CAT = "cat as (select * from demo qualify row_number() over (partition by pair_id order by extracted_at desc nulls last) = 1)"
MEM = "mem as (select * from tm_entries qualify row_number() over (partition by entry_id order by ingested_at desc nulls last) = 1)"
REV = "rev as (select * from tm_revisions qualify row_number() over (partition by id order by revised_at) = 1)"
STATE = "case when coalesce(frozen, false) then 'frozen' when lower(trim(coalesce(status, ''))) = 'needs_review' then 'needs_review' when coalesce(target, '') <> '' then 'translated' else 'missing' end"
COUNTS = ", ".join(f"count(*) filter (state = '{s}') as {s}" for s in ("translated", "missing", "needs_review", "frozen")) + ", count(*) as total"
BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANKS}', ' ', 'g'))"


def html(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def po(x: str) -> str:
    return rf"""replace(replace(replace(coalesce({x}, ''), '\', '\\'), '"', '\"'), chr(10), '\n')"""


#: Links without a look-behind: images go first.
def link(x: str, group: int) -> str:
    return rf"list_transform(regexp_extract_all(regexp_replace(coalesce({x}, ''), '!\[([^\]]*)\]\(([^)]+)\)', '', 'g'), '\[([^\]]+)\]\(([^)]+)\)', {group}), lambda u: trim(u))"


def image(x: str, group: int) -> str:
    return rf"list_transform(regexp_extract_all(coalesce({x}, ''), '!\[([^\]]*)\]\(([^)]+)\)', {group}), lambda u: trim(u))"


def code(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '`([^`]+)`', 1)"


def holes(x: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all(coalesce({x}, ''), '(\{{\{{[^}}]+\}}\}}|\{{[A-Za-z_][A-Za-z0-9_]*\}}|%[sd]|:[A-Za-z_][A-Za-z0-9_]*|<[^>\s]+>)', 1)))"


def tags(x: str) -> str:
    return rf"regexp_extract_all(coalesce({x}, ''), '(</?[A-Z][A-Za-z0-9_.]*\b[^>]*>)', 1)"
