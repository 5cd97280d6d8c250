"""Queries of the checks and repairs of translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import jsonish
from verbaloom.functions import text as T
from verbaloom.operators import qa
from verbaloom.plans.common import CAT, catalogue, code, holes, html, image, link, query, tags

#: Segments of the tables hold few links and tags, so markup is put round them by their number, alike in both engines.
SRC = "case ord % 6 when 0 then '[doc](http://x/' || ord || ') ' || s when 1 then '`cmd` {{n}} ' || s when 2 then '![i](u.png) <Tab a=\"1\"> ' || s else s end"
TGT = "case when t = '' then '' when ord % 6 = 0 and ord % 4 = 0 then '[doc](http://y/' || ord || ') ' || t when ord % 6 = 1 and ord % 4 = 1 then '`cmd` ' || t when ord % 6 = 2 and ord % 4 = 2 then '![i](w.png) ' || t else t end"
MARKED = f"{CAT}, p as (select *, coalesce(source, '') as s, coalesce(target, '') as t from cat), l as (select pair_id, id, kind, {SRC} as source, {TGT} as target from p where not coalesce(frozen, false))"


def marked(spark: SparkSession, base: str) -> DataFrame:
    cat = catalogue(spark, base, "id kind ord frozen source target meta").withColumns({"s": T.text_or_empty(F.col("source")), "t": T.text_or_empty(F.col("target"))})
    return cat.withColumns({"source": F.expr(SRC), "target": F.expr(TGT)})


def _rule(number: int, test: str):
    sql = f"with {MARKED} select pair_id from l where target <> '' and {test}"

    def run(spark: SparkSession, base: str) -> DataFrame:
        return qa.lint(marked(spark, base), ["pair_id"]).filter(F.col("rule") == f"L{number}").select("pair_id")

    return sql, run


LS, LT, IS, IT = link("source", 2), link("target", 2), image("source", 2), image("target", 2)
TESTS = {
    1: f"len({LS}) <> len({LT})",
    2: f"len({LS}) = len({LT}) and {LS} <> {LT}",
    3: f"len({IS}) <> len({IT})",
    4: f"len({IS}) = len({IT}) and {IS} <> {IT}",
    5: f"len({code('source')}) <> len({code('target')})",
    6: "length(source) > 20 and length(target) > length(source) * 1.5",
    7: "length(source) > 20 and length(target) < length(source) * 0.45",
    8: f"{holes('source')} <> {holes('target')}",
    9: f"{tags('source')} <> {tags('target')}",
}
for _n, _name in ((1, "lint_links"), (2, "lint_link_urls"), (3, "lint_images"), (4, "lint_image_urls"), (5, "lint_codes"), (6, "lint_expansion"), (7, "lint_contraction"), (8, "lint_placeholders"), (9, "lint_jsx")):
    _sql, _run = _rule(_n, TESTS[_n])
    query(_sql, _name)(_run)


@query(f"with {MARKED} " + " union all ".join(f"select 'L{n}' as rule, count(*) as n from l where target <> '' and {t} having count(*) > 0" for n, t in TESTS.items()))
def lint_summary(spark: SparkSession, base: str) -> DataFrame:
    return qa.lint(marked(spark, base), ["pair_id"]).groupBy("rule").agg(F.count("*").alias("n"))


def _list(x: str) -> str:
    """A list of strings as Python shows it."""
    safe = rf"replace(u, '\', '\\')"
    return f"""'[' || array_to_string(list_transform({x}, lambda u: case when not contains(u, chr(39)) then chr(39) || {safe} || chr(39) when not contains(u, '"') then '"' || {safe} || '"' else chr(39) || replace({safe}, chr(39), '\' || chr(39)) || chr(39) end), ', ') || ']'"""


def _both(head: str, of: str, tail: str = "") -> str:
    return f"'{head}source=' || {of.replace('?', 'source')} || ' target=' || {of.replace('?', 'target')} || '{tail}'"


_LONG = lambda head, tail: f"'{head}source_len=' || length(source) || ' target_len=' || length(target) || '{tail}'"
SAID = {
    1: f"'Markdown link count changed: source=' || len({LS}) || ' target=' || len({LT})", 2: "'Markdown link URLs changed.'", 3: f"'Image count changed: source=' || len({IS}) || ' target=' || len({IT})", 4: "'Image URLs changed.'",
    5: f"'Inline code span count changed: source=' || len({code('source')}) || ' target=' || len({code('target')})", 6: _LONG("Text expansion > 50%: ", ". UI layout might break."), 7: _LONG("Text contraction > 55%: ", ". Meaning may be missing."),
    8: f"'Placeholder mismatch: source=' || {_list(holes('source'))} || ' target=' || {_list(holes('target'))}", 9: f"'JSX/MDX tag mismatch: source=' || {_list(tags('source'))} || ' target=' || {_list(tags('target'))}",
}
MESSAGES = f"{MARKED}, i as (" + " union all ".join(f"select pair_id, id, kind, source, target, 'L{n}' as rule, {SAID[n]} as message from l where target <> '' and {t}" for n, t in TESTS.items()) + ")"


@query(f"with {MESSAGES} select pair_id, rule, '[WARN] token=' || coalesce(id, '') || ' kind=' || coalesce(kind, '') || chr(10) || '       ' || message || chr(10) || '       Source: ' || coalesce(source, '') || chr(10) || '       Target: ' || target as line from i")
def lint_messages(spark: SparkSession, base: str) -> DataFrame:
    found = qa.issues(marked(spark, base), ["pair_id"])
    return found.select("pair_id", "rule", qa.format_issue(*[F.col(c) for c in ("level", "id", "kind", "message", "source", "target")]).alias("line"))


@query(f"""with {CAT}, own as (select * from cat where not coalesce(frozen, false) and target <> '' and id is not null), e as (select id, kind, source, target from own qualify row_number() over (partition by id order by ord desc nulls last, kind desc nulls last, source desc nulls last, target desc nulls last) = 1),
r as (select distinct id from own where lower(trim(coalesce(status, ''))) = 'needs_review') select e.id, e.kind, 'ai-warn' as level, 'Check ' || e.id as message, e.source, e.target from r join e using (id)""")
def ai_lint_join(spark: SparkSession, base: str) -> DataFrame:
    """A model reports every segment to be reviewed, in a fenced list by page, besides an id that no segment has."""
    cat = catalogue(spark, base, "doc_path ord id kind frozen source target status")
    item = F.struct("id", F.concat(F.lit("Check "), "id").alias("rule_violated"))
    asked = qa.lintable(cat).filter((F.lower(F.trim(T.text_or_empty(F.col("status")))) == "needs_review") & F.col("id").isNotNull())
    unknown = F.array(F.struct(F.lit("unknown").alias("id"), F.lit("none").alias("rule_violated")))
    replies = asked.groupBy("doc_path").agg(F.concat(F.lit("```json\n"), F.to_json(F.array_union(F.collect_set(item), unknown)), F.lit("\n```")).alias("reply"))
    return qa.model_issues(cat, replies, "reply").distinct()


#: Ends of words by Unicode, which DuckDB's expressions don't know.
NO_WORD = r"[^\p{L}\p{N}\p{M}_]"


@query(rf"with {CAT} select pair_id, lower(regexp_extract(target, '(?i)(^|{NO_WORD})(du|dir|dein|dich|euch|ihr)($|{NO_WORD})', 2)) as word from cat where not coalesce(frozen, false) and target <> '' and regexp_matches(target, '(?i)(^|{NO_WORD})(du|dir|dein|dich|euch|ihr)($|{NO_WORD})')")
def ai_lint_tone(spark: SparkSession, base: str) -> DataFrame:
    return qa.tone(catalogue(spark, base, "frozen target"), ["pair_id"], "Bitte Sie verwenden")


@query(rf"with {CAT}, a as (select pair_id, target, list_filter(regexp_extract_all('MyTool ' || source, '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+')) as n from cat where not coalesce(frozen, false) and target <> ''), u as (select pair_id, target, unnest(n) as product from a) select pair_id, product from u where not contains(target, product)")
def ai_lint_product_case(spark: SparkSession, base: str) -> DataFrame:
    cat = catalogue(spark, base, "frozen source target").withColumn("source", F.concat(F.lit("MyTool "), F.col("source")))
    return qa.lost_products(cat, ["pair_id"])


@query(f"""with {MARKED}, k as (select * from l where target <> '' and not contains(source, '[doc]')),
i as (select *, case when len({IS}) > 0 and len({IT}) = 0 then target || chr(10) || chr(10) || array_to_string(list_transform({IS}, lambda u: '![i](' || u || ')'), chr(10)) else target end as a from k where len({image('source', 1)}) = 0 or {image('source', 1)} = ['i']),
c as (select *, a || coalesce(array_to_string(list_transform(list_filter(list_distinct({code('source')}), lambda x: not list_contains({code('a')}, x)), lambda x: ' `' || x || '`'), ''), '') as b from i where len(list_distinct({code('source')})) <= 1),
h as (select *, b || coalesce(array_to_string(list_transform(list_filter({holes('source')}, lambda x: not list_contains({holes('b')}, x)), lambda x: ' ' || x), ''), '') as d from c),
g as (select *, trim(d || coalesce(array_to_string(list_transform(list_filter({tags('source')}, lambda x: not list_contains({tags('d')}, x)), lambda x: ' ' || x), ''), '')) as fixed from h)
select pair_id, sha256(fixed) as fixed from g where fixed <> trim(target)""")
def autofix_append(spark: SparkSession, base: str) -> DataFrame:
    """Segments without links and with one code span at most, whose order SQL can keep."""
    from verbaloom.functions import markup as M

    rows = marked(spark, base).filter(~F.contains("source", F.lit("[doc]")) & (F.size(F.array_distinct(M.code_spans(F.col("source")))) <= 1))
    rows = rows.filter((F.size(M.image_labels(F.col("source"))) == 0) | (M.image_labels(F.col("source")) == F.array(F.lit("i"))))
    return qa.repaired(rows).select("pair_id", F.sha2("fixed", 256).alias("fixed"))


@query()
def autofix(spark: SparkSession, base: str) -> DataFrame:
    """Every segment, with what was done and what the segment's meta data say of it."""
    return qa.repaired(marked(spark, base)).select("pair_id", "fixed", "status", F.array_join("notes", "\n").alias("notes"), "meta")


@query(f"""with {CAT}, b as (select id as token, case when kind = 'heading' then 'h1' when kind = 'table_cell' then 'td' else 'p' end as tag, coalesce(target, '') as text from cat where id is not null),
s as (select token, tag, length(trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) as chars, case when tag = 'h1' then 120 when tag = 'td' then 80 else 240 end as most from b) select * from s where chars > most""")
def visual_overflow(spark: SparkSession, base: str) -> DataFrame:
    tag = F.when(F.col("kind") == "heading", "h1").when(F.col("kind") == "table_cell", "td").otherwise("p")
    blocks = catalogue(spark, base, "id kind target").filter("id is not null").select(F.col("id").alias("token"), tag.alias("tag"), T.text_or_empty(F.col("target")).alias("text"))
    return qa.visual(blocks).drop("shown")


@query(f"""with {CAT}, b as (select doc_path, id as token, case when kind = 'heading' then 'h1' when kind = 'table_cell' then 'td' else 'p' end as tag, coalesce(target, '') as text from cat where id is not null),
s as (select doc_path, token, tag, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) as t, case when tag = 'h1' then 120 when tag = 'td' then 80 else 240 end as most from b)
select doc_path, token, '[VISUAL-WARN] ' || doc_path || ' token=' || token || chr(10) || '       Potential overflow: <' || tag || '> has ' || length(t) || ' visible chars (limit ' || most || ').' || chr(10) || '       Text: ' || substring(t, 1, 240) as line from s where length(t) > most""")
def visual_messages(spark: SparkSession, base: str) -> DataFrame:
    tag = F.when(F.col("kind") == "heading", "h1").when(F.col("kind") == "table_cell", "td").otherwise("p")
    rows = catalogue(spark, base, "doc_path id kind target").filter("id is not null").select("doc_path", F.col("id").alias("token"), tag.alias("tag"), T.text_or_empty(F.col("target")).alias("text"))
    found = qa.visual(rows, "doc_path")
    return found.select("doc_path", "token", qa.format_visual(*[F.col(c) for c in ("doc_path", "token", "tag", "chars", "most", "shown")]).alias("line"))


@query(f"with {CAT} select id as token, 'td' as tag, {html('coalesce(source, %s)' % (chr(39) * 2))} as text from cat where id is not null")
def token_blocks(spark: SparkSession, base: str) -> DataFrame:
    return _blocks(catalogue(spark, base, "id source"))


def _blocks(cat: DataFrame) -> DataFrame:
    rows = cat.filter("id is not null")
    page = rows.select(F.concat(F.lit('<table><tr><td data-token="'), F.col("id"), F.lit('">'), T.html_escape(F.col("source")), F.lit("</td></tr></table>")).alias("html"))
    return qa.token_blocks(page.withColumn("html", F.regexp_replace("html", "^<table><tr>|</tr></table>$", "")), "html")


@query(rf"""with {CAT}, r as (select pair_id, '```json' || chr(10) || '{{"translations": [' || to_json(coalesce(target, '')) || ',],}}' || chr(10) || '```' as reply from cat)
select pair_id, json_extract_string(regexp_replace(substring(reply, 9, length(reply) - 12), '("[^"\\]*(?:\\.[^"\\]*)*")|,\s*([\]}}])', '\1\2', 'g'), '$.translations[0]') as target from r""")
def json_repair(spark: SparkSession, base: str) -> DataFrame:
    return _from_reply(catalogue(spark, base, "target"))


def _from_reply(cat: DataFrame) -> DataFrame:
    inner = F.regexp_extract(F.to_json(F.struct(T.text_or_empty(F.col("target")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    reply = F.concat(F.lit('```json\n{"translations": ['), inner, F.lit(",],}\n```"))
    return cat.select("pair_id", F.get_json_object(jsonish.repaired(reply), "$.translations[0]").alias("target"))


@query(f"with {CAT} select pair_id::varchar as batch, id, target, true as ok from cat where id is not null and target is not null")
def translation_lists(spark: SparkSession, base: str) -> DataFrame:
    return _from_lists(catalogue(spark, base, "id target"))


def _from_lists(cat: DataFrame) -> DataFrame:
    rows = cat.filter("id is not null and target is not null")
    reply = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.array(F.struct("id", "target")).alias("items"))), F.lit(" done"))
    return jsonish.translations(rows.select("pair_id", F.array("id").alias("ids"), reply.alias("reply")), "pair_id", "ids", "reply")
