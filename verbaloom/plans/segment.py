"""Queries on documents: segmentation, markup, front matter, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import markup as M
from verbaloom.functions import text as T
from verbaloom.operators import segment as S
from verbaloom.operators import site
from verbaloom.plans.common import BLANKS, CAT, catalogue, norm, query
from verbaloom.session import table

FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"
UNIX = r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')"
LINES = f"""raw as (select doc_id as doc, string_split(regexp_replace({UNIX}, '{FRONT}', ''), chr(10)) as a from documents where text is not null),
ln as (select doc, generate_subscripts(a, 1) - 1 as pos, unnest(a) as line from raw),
fe as (select *, (regexp_matches(line, '^ {{0,3}}```'))::int as fence from ln),
fs as (select *, sum(fence) over (partition by doc order by pos) as fences from fe),
ty as (select *, case when fence = 1 then 'fence' when fences % 2 = 1 then 'code_block' when trim(line) = '' then 'blank' when regexp_matches(line, '^#{{1,6}}\\s+\\S') then 'heading' when regexp_matches(line, '^:::') then 'fence'
  when regexp_matches(line, '^>') then 'blockquote' when regexp_matches(line, '^([-*+]|\\d+[.)])\\s+\\S') then 'list_item' when regexp_matches(line, '^\\|') then 'table_row' else 'paragraph' end as kind from fs),
st as (select *, case when lag(kind) over (partition by doc order by pos) = kind and kind not in ('heading', 'list_item', 'table_row') then 0 else 1 end as start from ty),
isl as (select *, sum(start) over (partition by doc order by pos) as island from st),
bl as (select doc, island, kind, min(pos) as pos, string_agg(line, chr(10) order by pos) as src_text from isl where kind not in ('blank', 'fence') group by doc, island, kind),
blocks as (select doc, kind, row_number() over (partition by doc, kind order by pos) - 1 as idx, pos, src_text from bl)"""


def _blocks(spark: SparkSession, base: str) -> DataFrame:
    return S.line_blocks(table(spark, base, "documents").filter("text is not null"), "doc_id", "text")


@query(f"with {LINES} select doc, kind, idx, pos, sha256(src_text) as hash from blocks")
def segment_blocks(spark: SparkSession, base: str) -> DataFrame:
    return _blocks(spark, base).select("doc", "kind", "idx", "pos", F.sha2("src_text", 256).alias("hash"))


@query(f"with {LINES} select doc, pos, substring(sha256(doc || '::' || kind || '[' || idx || ']::' || {norm('src_text')}), 1, 12) as id from blocks")
def segment_ids(spark: SparkSession, base: str) -> DataFrame:
    return _blocks(spark, base).select("doc", "pos", T.segment_id(F.col("doc").cast("string"), F.col("kind"), F.col("idx"), F.col("src_text")).alias("id"))


@query(f"with {LINES} select doc, kind, count(*) as n, max(idx) as last from blocks group by doc, kind")
def kind_ordinals(spark: SparkSession, base: str) -> DataFrame:
    return _blocks(spark, base).groupBy("doc", "kind").agg(F.count("*").alias("n"), F.max("idx").alias("last"))


@query(f"with {LINES} select doc, idx, src_text from blocks where kind = 'code_block'")
def code_fences(spark: SparkSession, base: str) -> DataFrame:
    return _blocks(spark, base).filter("kind = 'code_block'").select("doc", "idx", "src_text")


@query(rf"with {LINES} select doc, idx, length(regexp_extract(src_text, '^(#{{1,6}})\s', 1)) as level, trim(regexp_extract(src_text, '^#{{1,6}}\s+(.*)$', 1)) as title from blocks where kind = 'heading'")
def heading_toc(spark: SparkSession, base: str) -> DataFrame:
    level, title = F.length(F.regexp_extract("src_text", r"^(#{1,6})\s", 1)), F.trim(F.regexp_extract("src_text", r"(?d)^#{1,6}\s+(.*)$", 1))
    return _blocks(spark, base).filter("kind = 'heading'").select("doc", "idx", level.alias("level"), title.alias("title"))


@query(rf"""with {LINES}, c as (select doc, pos, list_transform(string_split(regexp_replace(src_text, '^\||\|\s*$', '', 'g'), '|'), lambda x: trim(x)) as a from blocks where kind = 'table_row' and not regexp_matches(src_text, '^[|\s:-]+$'))
select doc, pos, generate_subscripts(a, 1) - 1 as col, unnest(a) as cell from c""")
def table_cells(spark: SparkSession, base: str) -> DataFrame:
    rows = _blocks(spark, base).filter((F.col("kind") == "table_row") & ~F.col("src_text").rlike(r"^[|\s:-]+$"))
    return rows.select("doc", "pos", F.posexplode(F.transform(F.split(F.regexp_replace("src_text", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))).alias("col", "cell"))


@query(rf"with {LINES} select doc, idx, regexp_replace(regexp_replace(src_text, '^> ?', '', 'g'), chr(10) || '> ?', chr(10), 'g') as quote from blocks where kind = 'blockquote'")
def blockquotes(spark: SparkSession, base: str) -> DataFrame:
    quote = F.regexp_replace(F.regexp_replace("src_text", "^> ?", ""), "\n> ?", "\n")
    return _blocks(spark, base).filter("kind = 'blockquote'").select("doc", "idx", quote.alias("quote"))


ADMONITION = r"(?s)\n:::\s*([a-zA-Z0-9_-]+)(?:[ \t]+([^\n]*))?\n(.*?)\n:::"


@query(f"""with a as (select doc_id, chr(10) || {UNIX} as t from documents where text is not null), m as (select doc_id, regexp_extract_all(t, '{ADMONITION}', 1) as k, regexp_extract_all(t, '{ADMONITION}', 2) as ti, regexp_extract_all(t, '{ADMONITION}', 3) as b from a)
select doc_id, generate_subscripts(k, 1) - 1 as pos, unnest(k) as type, unnest(ti) as title, trim(unnest(b)) as body from m""")
def admonitions(spark: SparkSession, base: str) -> DataFrame:
    text = F.concat(F.lit("\n"), T.unix_lines(F.col("text")))
    parts = [F.regexp_extract_all(text, F.lit(ADMONITION), F.lit(g)).alias(n) for g, n in ((1, "type"), (2, "title"), (3, "body"))]
    rows = table(spark, base, "documents").filter("text is not null").select("doc_id", F.posexplode(F.arrays_zip(*parts)).alias("pos", "a"))
    return rows.select("doc_id", "pos", "a.type", "a.title", F.trim("a.body").alias("body"))


@query()
def segments(spark: SparkSession, base: str) -> DataFrame:
    """The whole grammar; tested against hand-made goldens, as SQL has no nested containers."""
    docs = table(spark, base, "documents").withColumn("place", F.coalesce("path", F.concat(F.lit("doc/"), F.col("doc_id"))))
    return S.segments(docs, "place", "text").select("doc_path", "ord", "kind", "idx", "id", "fingerprint", "frozen")


@query()
def document_ir(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").withColumn("place", F.concat(F.lit("doc/"), F.col("doc_id")))
    return S.document_ir(S.segments(docs, "place", "text"))


MARKED = "m0 as (select pair_id, case ord % 3 when 0 then '[see](u/' || ord || ') ' || coalesce(source, '') when 1 then '![pic ' || ord || '](a.png) [x](y)[z](w) ' || coalesce(source, '') else coalesce(source, '') end as source from cat)"


def _listed(spark: SparkSession, base: str, expr, name: str) -> DataFrame:
    """Segments of the tables hold few links and images, so some are put before them, alike in both engines."""
    marked = F.expr("case ord % 3 when 0 then '[see](u/' || ord || ') ' || coalesce(source, '') when 1 then '![pic ' || ord || '](a.png) [x](y)[z](w) ' || coalesce(source, '') else coalesce(source, '') end")
    return catalogue(spark, base, "ord source").withColumn("source", marked).select("pair_id", F.posexplode(expr(F.col("source"))).alias("pos", name))


@query(rf"with {CAT}, {MARKED}, m as (select pair_id, regexp_extract_all(regexp_replace(coalesce(source, ''), '!\[([^\]]*)\]\(([^)]+)\)', '', 'g'), '\[([^\]]+)\]\(([^)]+)\)', 1) as a from m0) select pair_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as label from m")
def link_text(spark: SparkSession, base: str) -> DataFrame:
    return _listed(spark, base, M.link_labels, "label")


@query(rf"with {CAT}, {MARKED}, m as (select pair_id, regexp_extract_all(coalesce(source, ''), '!\[([^\]]*)\]\(([^)]+)\)', 1) as a from m0) select pair_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as label from m")
def image_alt(spark: SparkSession, base: str) -> DataFrame:
    return _listed(spark, base, M.image_labels, "label")


@query(f"with {CAT}, {MARKED}, m as (select pair_id, regexp_extract_all(coalesce(source, ''), '`([^`]+)`', 1) as a from m0) select pair_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as code from m")
def code_spans(spark: SparkSession, base: str) -> DataFrame:
    return _listed(spark, base, M.code_spans, "code")


PROP = r"""\b(title|label|description|alt|aria-label|placeholder)=["'']([^"'']+)["'']"""
TAGGED = "'<Card title=\"' || coalesce(source, '') || '\" label=''x''>' || coalesce(target, '') || '</Card>'"


@query(f"with {CAT}, m as (select pair_id, regexp_extract_all({TAGGED}, '{PROP}', 1) as a, regexp_extract_all({TAGGED}, '{PROP}', 2) as b from cat) select pair_id, generate_subscripts(a, 1) - 1 as ordinal, unnest(a) as prop, unnest(b) as value from m")
def jsx_props(spark: SparkSession, base: str) -> DataFrame:
    tagged = F.concat(F.lit('<Card title="'), T.text_or_empty(F.col("source")), F.lit("\" label='x'>"), T.text_or_empty(F.col("target")), F.lit("</Card>"))
    return catalogue(spark, base, "source target").select("pair_id", F.posexplode(M.props(tagged)).alias("ordinal", "p")).select("pair_id", "ordinal", "p.prop", "p.value")


@query(f"""with {CAT}, c as (select pair_id, 0 as ordinal, 'Tab' as component, regexp_replace(regexp_replace(coalesce(source, ''), '<[^>]+>', '', 'g'), '^{BLANKS}|{BLANKS}$', '', 'g') as text from cat union all select pair_id, 1, 'Note', regexp_replace(regexp_replace(coalesce(target, ''), '<[^>]+>', '', 'g'), '^{BLANKS}|{BLANKS}$', '', 'g') from cat) select * from c where text <> ''""")
def jsx_children(spark: SparkSession, base: str) -> DataFrame:
    tagged = F.concat(F.lit("<Tab>"), T.text_or_empty(F.col("source")), F.lit("</Tab><Note><b>"), T.text_or_empty(F.col("target")), F.lit("</b></Note>"))
    return catalogue(spark, base, "source target").select("pair_id", F.posexplode(M.children(tagged)).alias("ordinal", "c")).select("pair_id", "ordinal", "c.component", "c.text").filter("text <> ''")


@query(rf"with {CAT}, m as (select pair_id, list_filter(list_transform(regexp_extract_all('![a](img/' || id || '.png) ![b](https://x.y/z.png) ' || coalesce(source, ''), '!\[([^\]]*)\]\(([^)]+)\)', 2), lambda u: trim(u)), lambda u: u <> '' and not regexp_matches(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|#|//)')) as a from cat) select pair_id, unnest(a) as ref from m")
def asset_refs(spark: SparkSession, base: str) -> DataFrame:
    text = F.concat(F.lit("![a](img/"), F.col("id"), F.lit(".png) ![b](https://x.y/z.png) "), T.text_or_empty(F.col("source")))
    return catalogue(spark, base, "id source").select("pair_id", F.explode(M.asset_refs(text)).alias("ref"))


VALUE = lambda key: f"""regexp_replace(trim(regexp_replace(list_filter(string_split(regexp_extract({UNIX}, '{FRONT}', 1), chr(10)), lambda l: regexp_matches(l, '^\\s*{key}\\s*:'))[-1], '^\\s*{key}\\s*:', '')), '^["'']+|["'']+$', '', 'g')"""


@query(f"select doc_id, sha256(regexp_extract({UNIX}, '{FRONT}', 1)) as front, {VALUE('title')} as title, {VALUE('version')} as version from documents where regexp_extract({UNIX}, '{FRONT}', 1) <> ''")
def front_matter(spark: SparkSession, base: str) -> DataFrame:
    c = T.unix_lines(T.text_or_empty(F.col("text")))
    rows = table(spark, base, "documents").filter(T.front_matter(c) != "")
    return rows.select("doc_id", F.sha2(T.front_matter(c), 256).alias("front"), T.front_value(c, "title").alias("title"), T.front_value(c, "version").alias("version"))


STEM = r"regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '')"
TITLE = f"coalesce(nullif({VALUE('title')}, ''), nullif(trim(regexp_extract({UNIX}, '(?m)^#\\s+(.+)$', 1)), ''), {STEM})"


@query(f"select doc_id, {TITLE} as page_title from documents where path is not null")
def page_title(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("path is not null").select("doc_id", T.page_title(T.unix_lines(F.col("text")), F.col("path")).alias("page_title"))


@query(rf"select path as source, {TITLE} as title, regexp_replace(path, '\.[^./]*$', '') || '.html' as url, coalesce(try_cast({VALUE('order')} as int), 999) as page_order, sha256(substring(regexp_replace({UNIX}, '(?s)`{{3}}.*?`{{3}}', '', 'g'), 1, 8000)) as text from documents where path is not null")
def site_index(spark: SparkSession, base: str) -> DataFrame:
    return site.index(table(spark, base, "documents").filter("path is not null"), "path", "text").withColumn("text", F.sha2("text", 256))


@query("""with once as (select * from site_index qualify row_number() over (partition by source order by page_order, title, url, text) = 1)
select source, title, url, page_order from once where contains(lower(concat_ws(' ', title, text)), 'kataloge') order by page_order, title nulls first, source limit 8""")
def site_search(spark: SparkSession, base: str) -> DataFrame:
    return site.search(table(spark, base, "site_index"), "Kataloge")


BLANK = BLANKS.removesuffix("]+").removeprefix("[")


@query(rf"with {CAT} select pair_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(source, ''))), '[^\p{{L}}\p{{N}}_{BLANK}-]', '', 'g'), '[{BLANK}_]+', '-', 'g'), '-+', '-', 'g'), '-'), ''), 'section') as slug from cat")
def slugify(spark: SparkSession, base: str) -> DataFrame:
    return catalogue(spark, base, "source").select("pair_id", T.slug(F.col("source")).alias("slug"))


@query(r"""select distinct doc_path, lang, regexp_replace(regexp_replace(doc_path, '^docs/', ''), '\.[^./]*$', '') || case when lang = 'de' then '' else '.' || lang end || '.html' as html,
regexp_replace(regexp_replace(doc_path, '^docs/', ''), '\.[^./]*$', '') || '.catalog.json' as catalog from demo""")
def output_paths(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "demo").select("doc_path", "lang").distinct()
    return rows.select("doc_path", "lang", T.output_path(F.col("doc_path"), "html", F.col("lang")).alias("html"), T.output_path(F.col("doc_path"), "catalog.json").alias("catalog"))
