"""Queries that write catalogues in other forms and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import text as T
from verbaloom.operators import exchange as O
from verbaloom.plans.common import CAT, catalogue, html, po, query
from verbaloom.session import table, weighed

KEYS = ["doc_path", "lang"]
OPEN = f"{CAT}, op as (select * from cat where not coalesce(frozen, false))"


def _hashed(df: DataFrame, column: str) -> DataFrame:
    return df.select(*KEYS, F.sha2(column, 256).alias(column))


@query(f"""with {CAT}, t as (select doc_path, lang, ord, id || '(' || kind || case when coalesce(frozen, false) then ' frozen' else '' end || case when coalesce(status, '') in ('new', 'current', '') then '' else ' ' || status end || '): ' || replace(coalesce(source, ''), chr(10), '\\n') as line from cat)
select doc_path, lang, sha256(string_agg(line, chr(10) order by ord)) as text from t group by doc_path, lang""")
def tokens_listing(spark: SparkSession, base: str) -> DataFrame:
    return _hashed(O.token_listing(catalogue(spark, base), KEYS), "text")


@query(f"with {CAT} select pair_id, {po('source')} as source, {po('target')} as target from cat")
def po_escape(spark: SparkSession, base: str) -> DataFrame:
    return catalogue(spark, base, "source target").select("pair_id", T.po_escape(F.col("source")).alias("source"), T.po_escape(F.col("target")).alias("target"))


PO = f"""po as (select doc_path, lang, 'msgid ""' || chr(10) || 'msgstr ""' || chr(10) || '"Content-Type: text/plain; charset=UTF-8\\n"' || chr(10) || chr(10) || string_agg('#: ' || doc_path || chr(10) || '#. kind=' || coalesce(kind, '') || ' status=' || coalesce(status, '') || chr(10) || 'msgctxt "' || {po('id')} || '"' || chr(10) || 'msgid "' || {po('source')} || '"' || chr(10) || 'msgstr "' || {po('target')} || '"', chr(10) || chr(10) order by ord) || chr(10) as text from op group by doc_path, lang)"""


@query(f"with {OPEN}, {PO} select doc_path, lang, sha256(text) as text from po")
def po_export(spark: SparkSession, base: str) -> DataFrame:
    return _hashed(O.po_documents(catalogue(spark, base), KEYS), "text")


@query(f"with {OPEN} select doc_path, lang, id, coalesce(target, '') as target from op")
def po_import(spark: SparkSession, base: str) -> DataFrame:
    """Exported and read again: what comes back is what went in."""
    return O.po_entries(O.po_documents(catalogue(spark, base), KEYS), KEYS, "text")


@query(f"""with {OPEN}, n as (select doc_path, lang, id, max(case when ord % 2 = 0 and target <> '' then 'Neu "\\n' || chr(10) || target else coalesce(target, '') end) as new from op group by all)
select c.pair_id, case when coalesce(n.new, '') <> '' then n.new else c.target end as target, case when coalesce(n.new, '') <> '' then 'translated' else c.status end as status from cat c left join n using (doc_path, lang, id)""")
def po_import_merge(spark: SparkSession, base: str) -> DataFrame:
    """Every row is exported and imported, with every second target changed in between."""
    cat = catalogue(spark, base)
    edited = cat.withColumn("target", F.when((F.col("ord") % 2 == 0) & (F.col("target") != ""), F.concat(F.lit('Neu "\\n\n'), "target")).otherwise(F.col("target")))
    back = O.po_entries(O.po_documents(edited, KEYS), KEYS, "text")
    return O.po_merged(cat, back, KEYS).select("pair_id", "target", "status")


HELD = r"(`[^`]+`|\{\{[^}]+\}\}|</?[A-Z][A-Za-z0-9_.]*\b[^>]*>)"


def _xliff(x: str) -> str:
    plain, held = f"regexp_split_to_array(coalesce({x}, ''), '{HELD}')", f"regexp_extract_all(coalesce({x}, ''), '{HELD}')"
    return f"""array_to_string(list_transform(range(1, len({plain}) + 1), lambda k: {html(plain + '[k]')} || case when k <= len({held}) then '<ph id="' || k || '" equiv="' || {html(held + '[k]')} || '"/>' else '' end), '')"""


XLIFF = f"""with {OPEN}, u as (select doc_path, lang, ord, '<unit id="' || {html("coalesce(id, '')")} || '"><segment><source>' || {_xliff('source')} || '</source><target>' || {_xliff('target')} || '</target></segment></unit>' as unit from op)
select doc_path, lang, sha256('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xliff version="2.0" xmlns="urn:oasis:names:tc:xliff:document:2.0"><file id="' || {html('doc_path')} || '">' || chr(10) || string_agg(unit, chr(10) order by ord) || chr(10) || '</file></xliff>' || chr(10)) as text from u group by doc_path, lang"""


@query(XLIFF)
def xliff_export(spark: SparkSession, base: str) -> DataFrame:
    return _hashed(O.xliff_documents(catalogue(spark, base), KEYS), "text")


ENTRY = "coalesce(id, '') || '|' || coalesce(kind, '') || '|' || coalesce(source, '') || '|' || coalesce(target, '') || '|' || coalesce(frozen, false)::varchar || '|' || coalesce(fingerprint, '') || '|' || coalesce(status, '') || '|' || json(coalesce(meta, '{}'))"
FIELDS = ("id", "kind", "source", "target", "frozen", "fingerprint", "status", "meta")


def _read_back(made: DataFrame, member: str, fields: tuple[str, ...]) -> DataFrame:
    """Number of the entries of written JSON and a hash over their fields."""
    rows = F.from_json(F.get_json_object("json", f"$.{member}"), f"array<struct<{','.join(f'{c}:string' for c in fields)}>>")
    text = F.array_join(F.transform(rows, lambda e: F.concat_ws("|", *[e[c] for c in fields])), chr(10))
    return made.select(*KEYS, F.size(rows).cast("long").alias("entries"), F.sha2(text, 256).alias("whole"))


@query(f"with {OPEN} select doc_path, lang, count(*) as entries, sha256(string_agg({ENTRY}, chr(10) order by ord)) as whole from op group by doc_path, lang")
def catalog_write(spark: SparkSession, base: str) -> DataFrame:
    """Catalogues as they are written and read: all fields, meta data as an object, frozen segments left out."""
    return _read_back(O.catalogue_json(catalogue(spark, base), KEYS), "entries", FIELDS)


@query(f"with {CAT} select doc_path, lang, count(*) as entries, sha256(string_agg({ENTRY}, chr(10) order by ord)) as whole from cat group by doc_path, lang")
def catalog_write_frozen(spark: SparkSession, base: str) -> DataFrame:
    return _read_back(O.catalogue_json(catalogue(spark, base), KEYS, include_frozen=True), "entries", FIELDS)


@query(f"with {CAT} select doc_path, lang, count(*) as entries, sha256(string_agg(coalesce(id, '') || '|' || coalesce(kind, '') || '|' || coalesce(source, '') || '|' || coalesce(fingerprint, ''), chr(10) order by ord)) as whole from cat group by doc_path, lang")
def manifest_write(spark: SparkSession, base: str) -> DataFrame:
    """Manifests of all segments, frozen ones too."""
    return _read_back(O.manifest_json(catalogue(spark, base), KEYS), "nodes", ("id", "kind", "source", "fingerprint"))


def _fronts(spark: SparkSession, base: str) -> DataFrame:
    """Front matter of the pages that have a title."""
    titles = table(spark, base, "site_index").filter("title is not null").groupBy(F.col("source").alias("doc_path")).agg(F.min("title").alias("title"))
    return titles.select("doc_path", F.concat(F.lit("---\ntitle: "), "title", F.lit("\n---\n")).alias("front"))


FRONTS = "fr as (select source as doc_path, '---' || chr(10) || 'title: ' || min(title) || chr(10) || '---' || chr(10) as front from site_index where title is not null group by source)"


@query(f"""with {CAT}, {FRONTS} select doc_path, lang, any_value(coalesce(front, '')) as frontmatter, 'document' as type, count(*) as entries, sha256(string_agg(coalesce(id, '') || '|' || coalesce(kind, '') || '|' || coalesce(frozen, false)::varchar || '|' || json(coalesce(meta, '{{}}')), chr(10) order by ord)) as whole
from cat left join fr using (doc_path) group by doc_path, lang""")
def ir_write(spark: SparkSession, base: str) -> DataFrame:
    made = O.document_json(catalogue(spark, base), KEYS, _fronts(spark, base))
    read = _read_back(made, "nodes", ("id", "kind", "frozen", "meta"))
    head = made.select(*KEYS, F.get_json_object("json", "$.frontmatter").alias("frontmatter"), F.get_json_object("json", "$.type").alias("type"))
    return read.join(head, KEYS)


META = lambda k, d: f"coalesce(json_extract_string(meta, '$.{k}'), '{d}')"
RUNS = lambda where: f"""x as (select *, coalesce(nullif(target, ''), source, '') as t from cat where {where}), s as (select *, case when kind is not distinct from lag(kind) over w then 0 else 1 end as start from x window w as (partition by doc_path, lang order by ord)),
r as (select *, sum(start) over (partition by doc_path, lang order by ord) as run from s), p as (select *, row_number() over (partition by doc_path, lang, run order by ord) - 1 as place, coalesce(lead(run) over (partition by doc_path, lang order by ord) is distinct from run, true) as last from r)"""  # noqa: E731
MARKDOWN = f"""with {CAT}, {RUNS("kind not in ('image_alt', 'link_text', 'jsx_prop', 'jsx_child')")}, m as (select doc_path, lang, ord, case
when kind = 'heading' then repeat('#', {META('level', '1')}::int) || ' ' || t || chr(10) || chr(10)
when kind = 'list_item' then '- ' || replace(t, chr(10), chr(10) || '  ') || chr(10) || case when last then chr(10) else '' end
when kind = 'blockquote' then '> ' || replace(t, chr(10), chr(10) || '> ') || chr(10) || chr(10)
when kind = 'code_block' then '```' || {META('lang', '')} || chr(10) || rtrim(t, chr(10)) || chr(10) || '```' || chr(10) || chr(10)
when kind = 'admonition_title' then '::: ' || {META('admonition_type', 'note')} || ' ' || t || chr(10)
when kind = 'admonition_body' then t || chr(10) || ':::' || chr(10) || chr(10)
when kind = 'table_cell' then case when place % 2 = 0 then '| ' else '' end || t || case when place % 2 = 1 or last then ' |' else ' | ' end || case when place = 1 or (last and place < 2) then chr(10) || '| --- | --- |' else '' end || case when place % 2 = 1 or last then chr(10) else '' end || case when last then chr(10) else '' end
else t || chr(10) || chr(10) end as piece from p)
select doc_path, lang, sha256(regexp_replace(string_agg(piece, '' order by ord), '\\s+\\z', '') || chr(10)) as text from m group by doc_path, lang"""


@query(MARKDOWN.replace("with cat as", f"with {FRONTS}, cat as", 1).replace("select doc_path, lang, sha256(", "select doc_path, lang, sha256(any_value(coalesce(rtrim(front, chr(10)) || chr(10) || chr(10), '')) || ").replace("from m group by", "from m left join fr using (doc_path) group by"))
def render_markdown_front(spark: SparkSession, base: str) -> DataFrame:
    """Pages with their front matter before the text."""
    return _hashed(O.markdown_documents(O.shown(catalogue(spark, base)), KEYS, fronts=_fronts(spark, base)), "text")


@query(MARKDOWN)
def render_markdown(spark: SparkSession, base: str) -> DataFrame:
    return _hashed(O.markdown_documents(O.shown(catalogue(spark, base)), KEYS), "text")


@query()
def inline_html(spark: SparkSession, base: str) -> DataFrame:
    """Every shown text; runs of signs pair by rules that SQL can't express, so it is tested against cases by hand."""
    return O.shown(catalogue(spark, base, "source target")).select("pair_id", O.inline(F.col("shown")).alias("html"))


@query()
def render_html(spark: SparkSession, base: str) -> DataFrame:
    return O.html_documents(O.shown(O.diagrams(catalogue(spark, base))), KEYS)


@query()
def site_pages(spark: SparkSession, base: str) -> DataFrame:
    """Whole pages: navigation, contents and text. A page holds the links to all pages, megabytes on large sites."""
    spark = weighed(spark)
    cat = catalogue(spark, base)
    body = O.html_documents(O.shown(O.diagrams(cat)), KEYS).join(O.contents(cat.filter("id is not null"), KEYS), KEYS, "left")
    return O.page_html(body.join(F.broadcast(O.navigation(table(spark, base, "site_index")))), KEYS, F.col("nav"), F.col("toc"))


@query(f"""with {CAT} select doc_path, lang, sha256(string_agg('<li><a href="#' || id || '">' || {html("coalesce(nullif(target, ''), source, '')")} || '</a></li>', chr(10) order by ord)) as toc from cat where kind = 'heading' and id is not null group by doc_path, lang""")
def page_toc(spark: SparkSession, base: str) -> DataFrame:
    return _hashed(O.contents(catalogue(spark, base, "doc_path lang ord id kind source target").filter("id is not null"), KEYS), "toc")


@query(f"""with {CAT} select pair_id, case when kind = 'code_block' and ord % 2 = 0 then 'html_block' else kind end as kind from cat""")
def diagram_blocks(spark: SparkSession, base: str) -> DataFrame:
    """Every second code block is taken to be a diagram."""
    said = F.when((F.col("kind") == "code_block") & (F.col("ord") % 2 == 0), F.lit('{"lang": "mermaid"}')).otherwise(F.lit("{}"))
    return O.diagrams(catalogue(spark, base, "ord id kind frozen source target").withColumn("meta", said)).select("pair_id", "kind")
