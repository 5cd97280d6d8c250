"""Queries on terms and the glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbaloom.operators import terms as O
from verbaloom.plans.common import CAT, catalogue, query
from verbaloom.session import table

@query()
def term_scores(spark: SparkSession, base: str) -> DataFrame:
    """Every document. Ends of words beyond ASCII have no counterpart in DuckDB, so these three are tested against brute force."""
    return O.term_scores(table(spark, base, "documents"), "text")


@query()
def term_topk(spark: SparkSession, base: str) -> DataFrame:
    return O.top_terms(term_scores(spark, base), 80, 5)


@query()
def glossary_new_terms(spark: SparkSession, base: str) -> DataFrame:
    return O.new_terms(term_scores(spark, base), table(spark, base, "glossary"))


RELEVANT = f"""with {CAT}, g as (select distinct source, coalesce(target, '') as target, coalesce(note, '') as note, regexp_replace(lower(source), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g') as k from glossary where source <> ''),
c as (select pair_id, ' ' || regexp_replace(lower(coalesce(source, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g') || ' ' as t, lower(coalesce(source, '')) as low from cat)
select c.pair_id, g.source, g.target, g.note from c join g on contains(c.t, ' ' || g.k || ' ') and contains(c.low, lower(g.source))"""


@query(RELEVANT)
def glossary_relevant(spark: SparkSession, base: str) -> DataFrame:
    return O.relevant_terms(catalogue(spark, base, "source"), "pair_id", "source", table(spark, base, "glossary"))


@query(f"with r as ({RELEVANT}) select pair_id, 'Glossary entries that must be respected:' || chr(10) || string_agg('- ' || source || ' -> ' || target || case when note <> '' then ' (' || note || ')' else '' end, chr(10) order by '- ' || source || ' -> ' || target || case when note <> '' then ' (' || note || ')' else '' end) as prompt from r group by pair_id")
def glossary_prompts(spark: SparkSession, base: str) -> DataFrame:
    return O.glossary_prompt(glossary_relevant(spark, base), "pair_id")
