"""The queries of this subpackage: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.llm import canonical, fuzzy, language, leakage, neighbours, packing, pairs, residue
from verbaloom.session import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, base, "tm_entries"), "entry_id", "embedding", k=5, dim=96)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return fuzzy.duplicate_pairs(table(spark, base, "tm_entries"), "entry_id", ["source", "target"])


def p2_groups(spark: SparkSession, base: str) -> DataFrame:
    return fuzzy.duplicate_groups(table(spark, base, "tm_entries"), "entry_id", ["source", "target"])


def languages(spark: SparkSession, base: str) -> list[str]:
    """The codes of the small fixed table."""
    return sorted(r.code for r in table(spark, base, "lang_codes").select("code").distinct().collect())


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    found = language.mislabelled(table(spark, base, "tm_entries"), "entry_id", "target", "lang", languages(spark, base))
    return found.select(F.col("id").alias("entry_id"), "found_lang")


def p3_segments(spark: SparkSession, base: str) -> DataFrame:
    entries, codes = table(spark, base, "tm_entries"), languages(spark, base)
    net = language.fit(entries, "entry_id", "target", "lang", codes)
    return language.languages(entries.dropDuplicates(["entry_id"]), "entry_id", "target", net, by_segment=True)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    found = pairs.defects(table(spark, base, "demo"), langs=languages(spark, base))
    return found.select(F.col("id").alias("pair_id"), "defect")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    both = canonical.look_alikes(table(spark, base, "demo"), "pair_id", "source", table(spark, base, "tm_entries"), "entry_id", "source")
    return both.select(F.col("left_id").alias("pair_id"), F.col("right_id").alias("entry_id"))


def p5_forms(spark: SparkSession, base: str) -> DataFrame:
    """(table, id, form, key) of the sources of both tables."""

    def forms(name: str, ident: str) -> DataFrame:
        once = table(spark, base, name).select(ident, "source").dropDuplicates([ident])
        return canonical.canonical(once, ident, "source").select(F.lit(name).alias("table"), "id", "form", "key")

    return forms("demo", "pair_id").unionByName(forms("tm_entries", "entry_id"))


def p6_packed(spark: SparkSession, base: str) -> DataFrame:
    capacities = [r.capacity for r in table(spark, base, "pack_sizes").select("capacity").distinct().collect()]
    return packing.pack(table(spark, base, "documents"), "doc_id", "text", capacities)


def p6_fill(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill(p6_packed(spark, base))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    found = leakage.leaks(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id")


def p7_removed(spark: SparkSession, base: str) -> DataFrame:
    cut = leakage.remove_leaks(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "eval_items"), "item_id", "text")
    return cut.filter("removed_words > 0")


def p8_kinds(spark: SparkSession, base: str) -> DataFrame:
    return residue.residue(table(spark, base, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return p8_kinds(spark, base).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_segments": p3_segments,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_removed": p7_removed,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
}

#: Exact comparisons in SQL, where whole tables allow them.
SQL: dict[str, str] = {
    "p2_found": r"""with m as (select distinct entry_id, concat_ws(' ', source, target) as t from tm_entries where entry_id is not null),
w as (select entry_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) as w from m), o as (select entry_id, w, row_number() over (partition by entry_id, w) as k from w),
n as (select entry_id, count(*) as n from w group by entry_id), p as (select a.entry_id as x, b.entry_id as y, count(*) as i from o a join o b on a.w = b.w and a.k = b.k and a.entry_id < b.entry_id group by all)
select x as entry_a, y as entry_b from p join n a on a.entry_id = x join n b on b.entry_id = y where 5 * i >= 4 * (a.n + b.n - i)""",
    "p7_found": r"""with d as (select distinct doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null and doc_id is not null),
e as (select distinct item_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null and item_id is not null),
g as (select distinct id, array_to_string(w[k : k + 11], ' ') as g from (select id, w, unnest(range(1, len(w) - 10)) as k from e)),
h as (select id, array_to_string(w[k : k + 11], ' ') as g from (select id, w, unnest(range(1, len(w) - 10)) as k from d))
select distinct h.id as doc_id, g.id as item_id from h join g using (g)""",
}
