"""Queries that turn documents, taken as notes, into items, modules and generated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.operators import compose as O
from verbaloom.plans.common import BLANKS, query
from verbaloom.session import table

END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BULLET = r"^(?:[-*+]\s+|\d+[.)]\s+|\[[ xX]\]\s+)(.+)$"
ITEMS = rf"""raw as (select doc_id as doc, regexp_split_to_array(coalesce(text, ''), '{END}') as a from documents),
ln as (select doc, generate_subscripts(a, 1) - 1 as pos, trim(regexp_replace(unnest(a), '^{BLANKS}|{BLANKS}$', '', 'g')) as line from raw),
fe as (select *, starts_with(line, '```')::int as fence from ln),
fs as (select *, sum(fence) over (partition by doc order by pos) as fences from fe),
ty as (select *, case when fence = 1 then 'fence' when fences % 2 = 1 then 'code' when line = '' then 'blank' when starts_with(line, '#') then 'heading' when regexp_matches(line, '{BULLET}') then 'bullet' when length(line) < 160 and regexp_matches(line, '[:?]') then 'statement' else 'paragraph' end as kind from fs),
op as (select * from ty where kind <> 'code'),
st as (select *, case when kind = 'paragraph' and lag(kind) over (partition by doc order by pos) = 'paragraph' then 0 else 1 end as start from op),
isl as (select *, sum(start) over (partition by doc order by pos) as island from st),
ow as (select *, case when kind = 'heading' then trim(regexp_replace(line, '^#+', '')) when kind = 'bullet' then trim(regexp_extract(line, '{BULLET}', 1)) else line end as own from isl where kind not in ('blank', 'fence')),
gr as (select doc, island, kind, string_agg(own, ' ' order by pos) as text from ow group by doc, island, kind),
items as (select doc, row_number() over (partition by doc order by island) as item_index, text, kind, case kind when 'heading' then 0.8::double when 'bullet' then 0.72 when 'statement' then 0.7 else 0.65 end as confidence from gr where text <> '')"""


def _has(column: str, parts) -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{p}')" for p in parts) + ")"


QUESTION = "(contains(text, '?') or " + " or ".join(f"starts_with(lower(trim(text)), '{q}')" for q in O.QUESTIONS) + ")"
RISK, STEP = _has("text", O.RISKS), _has("text", O.STEPS)
SCORE = [" + ".join(f"contains(lower(text), '{k}')::int" for k in words) for _, words, _ in O.MODULES]
BEST = "greatest(" + ", ".join(f"({s}) * 10 + {8 - i}" for i, s in enumerate(SCORE)) + ")"
NAMES = "[" + ", ".join(f"'{n}'" for n, *_ in O.MODULES) + "]"
ROUTED = f"""{ITEMS}, sc as (select *, {BEST} as best from items),
su as (select *, case when best >= 10 then {NAMES}[9 - best % 10] when {QUESTION} or {RISK} then 'Risks and Open Questions' when {STEP} then 'Workflow' when kind = 'heading' then 'Concepts' end as sure from sc),
routed as (select doc, item_index, text, kind, coalesce(sure, case when coalesce(sum((sure is null or sure = 'Overview')::int) over (partition by doc order by item_index rows between unbounded preceding and 1 preceding), 0) < 6 then 'Overview' else 'Implementation' end) as module from su)"""


def _items(spark: SparkSession, base: str) -> DataFrame:
    return O.items(table(spark, base, "documents"), "doc_id", "text")


@query(f"with {ITEMS} select doc, item_index, sha256(text) as text, kind, confidence from items")
def notes_items(spark: SparkSession, base: str) -> DataFrame:
    return _items(spark, base).withColumn("text", F.sha2("text", 256))


@query(f"with {ROUTED} select doc, item_index, module from routed")
def notes_routing(spark: SparkSession, base: str) -> DataFrame:
    return O.routed(_items(spark, base)).select("doc", "item_index", "module")


@query(f"with {ROUTED} select doc, module, count(*) as n, min(item_index) as first_item, count(*) filter ({QUESTION}) as questions, count(*) filter (not {QUESTION} and {RISK}) as risks, count(*) filter (not {QUESTION} and not {RISK} and {STEP}) as steps from routed group by doc, module")
def notes_buckets(spark: SparkSession, base: str) -> DataFrame:
    rows = O.routed(_items(spark, base)).withColumn("role", O.sorted_role(F.col("text")))
    count = lambda r, n: F.count_if(F.col("role") == r).alias(n)
    return rows.groupBy("doc", "module").agg(F.count("*").alias("n"), F.min("item_index").alias("first_item"), count("open_questions", "questions"), count("risks", "risks"), count("steps", "steps"))


@query(f"""with {ROUTED}, q as (select doc, list(text order by item_index) filter ({QUESTION}) as q from items group by doc)
select doc, sha256(array_to_string(case when len(q) > 0 then q[1:20] else [{", ".join(f"'{x}'" for x in O.DEFAULT_QUESTIONS)}] end, chr(10))) as questions from q""")
def notes_questions(spark: SparkSession, base: str) -> DataFrame:
    return O.global_questions(_items(spark, base)).select("doc", F.sha2(F.array_join("questions", "\n"), 256).alias("questions"))


def _modules(spark: SparkSession, base: str) -> DataFrame:
    return O.modules(O.routed(_items(spark, base)))


@query(f"""with {ROUTED}, r as (select *, case when {QUESTION} then 'q' when {RISK} then 'r' when {STEP} then 's' else 'c' end as role from routed),
own as (select doc, module, list(text order by item_index) filter (role = 'c') as c, list(text order by item_index) filter (role = 's') as s, list('Note #' || item_index || ': ' || text order by item_index) as e from r group by doc, module),
f as (select distinct doc, unnest(['Overview', 'Risks and Open Questions']) as module from routed),
al as (select coalesce(own.doc, f.doc) as doc, coalesce(own.module, f.module) as module, c, s, e from own full join f on own.doc = f.doc and own.module = f.module)
select doc, module as title, sha256(coalesce(array_to_string(c[1:12], chr(10)), '')) as claims, sha256(coalesce(array_to_string(s[1:12], chr(10)), '')) as steps, sha256(coalesce(array_to_string(e[1:18], chr(10)), '')) as evidence from al""")
def notes_modules(spark: SparkSession, base: str) -> DataFrame:
    return _modules(spark, base).select("doc", "title", *[F.sha2(F.array_join(c, "\n"), 256).alias(c) for c in ("claims", "steps", "evidence")])


@query()
def open_questions(spark: SparkSession, base: str) -> DataFrame:
    return O.open_questions(_modules(spark, base), O.global_questions(_items(spark, base)))


@query()
def notes_documents(spark: SparkSession, base: str) -> DataFrame:
    """The generated documents and their index; tested against a hand-made golden."""
    notes, found = table(spark, base, "documents"), _items(spark, base)
    made = O.modules(O.routed(found))
    return O.module_documents(made).unionByName(O.index_documents(made, O.titles(notes, found, "doc_id", "text"), O.global_questions(found)))


@query(rf"""with {ITEMS}, s as (select doc, min_by(text, item_index) as said from items where kind in ('heading', 'statement') and length(text) between 6 and 90 group by doc)
select d.doc_id as doc, coalesce(case when regexp_matches(coalesce(text, ''), '(?m)^[ \t]*#') then trim(regexp_extract(text, '(?m)^[ \t]*#+([^\r\n]*)', 1)) end, regexp_replace(s.said, ':+$', ''), '{O.DEFAULT_TITLE}') as title from documents d left join s on s.doc = d.doc_id""")
def notes_titles(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").withColumn("text", F.replace("text", F.lit("\r"), F.lit("")))
    return O.titles(docs, _items(spark, base), "doc_id", "text")


@query(f"with {ITEMS} select doc, item_index as module, 'Part ' || item_index as title, 'part-' || item_index as slug, 'Organize related information.' as purpose, sha256(text) as claims, 1::int as items from items where kind = 'heading' qualify row_number() over (partition by doc order by item_index) = 1")
def notes_model_graph(spark: SparkSession, base: str) -> DataFrame:
    """Model replies as JSON, here made from the first heading, read and brought into shape."""
    first = _items(spark, base).filter("kind = 'heading'").groupBy("doc").agg(F.min(F.struct("item_index", "text")).alias("f"))
    module = F.struct(F.concat(F.lit("Part "), F.col("f.item_index")).alias("title"), F.array("f.text", F.lit(" ")).alias("claims"), F.array(F.col("f.item_index").cast("string"), F.lit("x")).alias("source_items"))
    graph = O.normalised_graph(first.select("doc", F.to_json(F.struct(F.array(module).alias("modules"))).alias("reply")), "doc", "reply")
    return graph.select("doc", F.col("source_items")[0].alias("module"), "title", "slug", "purpose", F.sha2(F.array_join("claims", "\n"), 256).alias("claims"), F.size("source_items").alias("items"))
