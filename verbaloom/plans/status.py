"""Queries on catalogues: status, joins with older states, neighbours, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import text as T
from verbaloom.operators import catalogue as C
from verbaloom.operators import plugins as P
from verbaloom.operators import qa
from verbaloom.operators.segment import translatable
from verbaloom.plans.common import CAT, COUNTS, STATE, catalogue, norm, query
from verbaloom.plans.lint import TESTS
from verbaloom.session import table

NAMED = f"named as (select *, {STATE} as state from cat)"


@query(f"with {CAT}, {NAMED} select doc_path, lang, {COUNTS} from named group by doc_path, lang")
def status_rollup(spark: SparkSession, base: str) -> DataFrame:
    return C.status_summary(catalogue(spark, base, "doc_path lang frozen status target"), ["doc_path", "lang"])


@query(f"with {CAT}, {NAMED} select doc_path, {COUNTS} from named group by doc_path")
def status_by_page(spark: SparkSession, base: str) -> DataFrame:
    return C.status_summary(catalogue(spark, base, "doc_path lang frozen status target"), ["doc_path"])


@query(f"with {CAT}, {NAMED} select doc_path, lang, {COUNTS}, cast(grouping(doc_path, lang) as bigint) as level from named group by grouping sets ((doc_path, lang), (lang), ())")
def status_grouping_sets(spark: SparkSession, base: str) -> DataFrame:
    return C.status_grouping_sets(catalogue(spark, base, "doc_path lang frozen status target"))


@query(f"with {CAT}, {NAMED}, s as (select doc_path, {COUNTS} from named group by doc_path) select *, " + ", ".join(f"{c} * 100.0::double / greatest(1, total) as {c}_pct" for c in C.COUNTED) + " from s")
def status_percentages(spark: SparkSession, base: str) -> DataFrame:
    return C.percentages(C.status_summary(catalogue(spark, base, "doc_path lang frozen status target"), ["doc_path"]))


PAGES = f"""with {CAT}, {NAMED}, own as (select doc_path, {COUNTS} from named where lang = 'en' group by doc_path),
pages as (select p.source as doc_path, own.total is not null as has_catalogue, {", ".join(f"coalesce({c}, 0) as {c}" for c in (*C.COUNTED, "total"))}
  from (select distinct source from site_index where source is not null) p left join own on own.doc_path = p.source)"""


@query(PAGES + " select * from pages")
def pages_missing_catalogue(spark: SparkSession, base: str) -> DataFrame:
    return C.pages_with_status(table(spark, base, "site_index"), catalogue(spark, base, "doc_path lang frozen status target"), "en")


@query(PAGES + """ select doc_path, case when not has_catalogue then '- `' || doc_path || '`: catalog missing' else '- `' || doc_path || '`: ' || translated || ' translated, ' || missing || ' missing, ' || needs_review || ' needs_review, ' || total || ' total' end as line from pages
union all select null, '**Summary:** ' || sum(translated) || ' translated, ' || sum(case when has_catalogue then missing else 1 end) || ' missing, ' || sum(needs_review) || ' needs_review, ' || sum(total) || ' total.' from pages""")
def ci_report(spark: SparkSession, base: str) -> DataFrame:
    return C.ci_report(pages_missing_catalogue(spark, base))


@query(f"with {CAT}, {NAMED} select lang, bool_or(state in ('missing', 'needs_review')) as failing from named group by lang")
def check_exit(spark: SparkSession, base: str) -> DataFrame:
    return C.unfinished(C.status_summary(catalogue(spark, base, "doc_path lang frozen status target"), ["doc_path", "lang"]))


def _issues(spark: SparkSession, base: str) -> DataFrame:
    return qa.lint(catalogue(spark, base, "doc_path frozen source target"), ["doc_path"]).groupBy("doc_path").agg(F.count("*").alias("lint_issues"))


FOUND = " union all ".join(f"select doc_path from t where {test}" for test in TESTS.values())


@query(f"""with {CAT}, {NAMED}, s as (select doc_path, {COUNTS} from named group by doc_path), t as (select * from cat where not coalesce(frozen, false) and target <> ''), f as ({FOUND}), i as (select doc_path, count(*) as n from f group by doc_path)
select s.*, coalesce(n, 0) as lint_issues, missing + needs_review + coalesce(n, 0) as attention from s left join i using (doc_path) order by attention desc, doc_path limit 10""")
def attention_topk(spark: SparkSession, base: str) -> DataFrame:
    """A top-k report."""
    return C.attention(C.status_summary(catalogue(spark, base, "doc_path lang frozen status target"), ["doc_path"]), _issues(spark, base), 10)


@query(f"with {CAT} select pair_id, {norm('source')} as norm, 'sha256:' || sha256({norm('source')}) as own, fingerprint = 'sha256:' || sha256({norm('source')}) as agrees from cat where source is not null")
def normalize_fingerprint(spark: SparkSession, base: str) -> DataFrame:
    own = T.fingerprint(F.col("source"))
    return catalogue(spark, base, "source fingerprint").filter("source is not null").select("pair_id", T.normalised(F.col("source")).alias("norm"), own.alias("own"), (F.col("fingerprint") == own).alias("agrees"))


@query(f"with {CAT} select sha256({norm('source')}) as source_key, lang, count(*) as n, count(distinct doc_path) as docs from cat where source is not null group by all having count(*) > 1")
def source_key_dups(spark: SparkSession, base: str) -> DataFrame:
    keyed = catalogue(spark, base, "source lang doc_path").filter("source is not null").withColumn("source_key", T.source_key(F.col("source")))
    return keyed.groupBy("source_key", "lang").agg(F.count("*").alias("n"), F.countDistinct("doc_path").alias("docs")).filter("n > 1")


@query(f"with {CAT} select pair_id, kind from cat where not coalesce(frozen, false) and kind not in ('code_block', 'html_block')")
def translatable_filter(spark: SparkSession, base: str) -> DataFrame:
    return translatable(catalogue(spark, base, "kind frozen")).select("pair_id", "kind")


@query(f"with {CAT} select pair_id, source from cat where not coalesce(frozen, false) and coalesce(target, '') = ''")
def missing_filter(spark: SparkSession, base: str) -> DataFrame:
    return C.needs_translation(catalogue(spark, base, "source frozen target")).select("pair_id", "source")


@query(f"""with {CAT}, seg as (select pair_id, lang, id, case when ord % 7 = 0 then 'needs_review' else 'new' end as status from cat),
e as (select lang, id, target, status from cat qualify row_number() over (partition by lang, id order by ord desc, pair_id desc) = 1)
select seg.pair_id, case when e.id is not null then coalesce(e.target, '') else '' end as target,
case when e.id is null then seg.status when seg.status = 'needs_review' or e.status = 'needs_review' then 'needs_review' when coalesce(e.target, '') <> '' then 'translated' else seg.status end as status from seg left join e on e.lang = seg.lang and e.id = seg.id""")
def catalog_merge(spark: SparkSession, base: str) -> DataFrame:
    """Every language, new segments without targets merged with its own entries."""
    old = catalogue(spark, base, "lang status target ord id")
    new = old.withColumns({"target": F.lit(""), "status": F.when(F.col("ord") % 7 == 0, "needs_review").otherwise("new")})
    once = old.groupBy("lang", "id").agg(F.max_by(F.struct("target", "status", "ord"), F.struct("ord", "pair_id")).alias("e")).select("lang", "id", "e.*")
    return C.merge_targets(new, once, ("lang",)).select("pair_id", "target", "status")


@query(f"with {CAT} select pair_id, coalesce(nullif(target, ''), source) as shown from cat")
def target_resolution(spark: SparkSession, base: str) -> DataFrame:
    return catalogue(spark, base, "target source").select("pair_id", C.resolved("target", "target", "source").alias("shown"))


@query(f"""with {CAT}, n as (select * replace (case when ord % 5 = 0 then '' else target end as target), lower(trim(coalesce(status, ''))) as said from cat),
best as (select lang, fingerprint, target, id from n where fingerprint is not null and target <> '' and said in ('translated', 'needs_review') qualify row_number() over (partition by lang, fingerprint order by ord desc, id desc) = 1)
select n.pair_id, best.target, best.id as synced_from_id from n join best using (lang, fingerprint) where not coalesce(n.frozen, false) and coalesce(n.target, '') = ''""")
def branch_sync(spark: SparkSession, base: str) -> DataFrame:
    """Every language; the branch to fill lacks every fifth target, and pages repeat some of their texts."""
    return _synced(catalogue(spark, base, "doc_path lang frozen status target ord id fingerprint"))


def _synced(cat: DataFrame) -> DataFrame:
    # The language stands for the page: texts are shared by all pages of a language.
    both = cat.withColumns({"status": F.lower(F.trim(T.text_or_empty(F.col("status")))), "doc_path": F.col("lang"), "target": F.when(F.col("ord") % 5 == 0, "").otherwise(F.col("target"))})
    # An id may come twice in a catalogue, so the pair's number stands for it on the side to fill.
    synced = C.sync_targets(both.withColumn("id", F.col("pair_id")), both)
    return synced.select(F.col("id").alias("pair_id"), "target", "synced_from_id")


@query(f"""with {CAT} select pair_id,
coalesce(last_value(case when not coalesce(frozen, false) then source end ignore nulls) over (partition by doc_path, lang order by ord rows between unbounded preceding and 1 preceding), '') as prev_source,
coalesce(first_value(case when not coalesce(frozen, false) then source end ignore nulls) over (partition by doc_path, lang order by ord rows between 1 following and unbounded following), '') as next_source from cat""")
def neighbor_context(spark: SparkSession, base: str) -> DataFrame:
    return C.neighbours(catalogue(spark, base, "doc_path lang ord frozen source"), ["doc_path", "lang"]).select("pair_id", "prev_source", "next_source")


@query(f"with {CAT} select doc_path, id, '[' || lang || '] ' || source as target, 'needs_review' as status, 'mock' as provider from cat where not coalesce(frozen, false) and coalesce(target, '') = '' and source <> ''")
def mock_translate(spark: SparkSession, base: str) -> DataFrame:
    return P.translate(catalogue(spark, base, "doc_path lang ord id frozen source target"), "mock", ["doc_path", "lang"]).drop("lang")


EDITS = "edits as (select distinct lang, id, '* ' || source as target from cat where lower(trim(coalesce(status, ''))) = 'needs_review' and id is not null and source <> '' qualify row_number() over (partition by lang, id order by source desc) = 1)"


def _edits(cat: DataFrame) -> DataFrame:
    chosen = cat.filter((F.lower(F.trim(T.text_or_empty(F.col("status")))) == "needs_review") & (F.col("source") != ""))
    return chosen.select("id", "lang", F.concat(F.lit("* "), "source").alias("target"), F.lit(None).cast("string").alias("status"))


@query(f"""with {CAT}, {EDITS}, hit as (select c.pair_id, e.target from cat c join edits e on e.lang = c.lang and e.id = c.id qualify row_number() over (partition by c.doc_path, c.lang, c.id order by c.ord) = 1)
select pair_id, target, 'translated' as status from hit""")
def token_updates(spark: SparkSession, base: str) -> DataFrame:
    """What is to be reviewed is edited by id: in each document the first entry with the id takes the text."""
    cat = catalogue(spark, base, "doc_path lang ord id source target status")
    return C.edited(cat, _edits(cat)).select("pair_id", "target", "status")


@query(f"""with {CAT}, {EDITS}, hit as (select c.pair_id, e.target from cat c join edits e on e.lang = c.lang and e.id = c.id qualify row_number() over (partition by c.doc_path, c.lang, c.id order by c.ord) = 1)
select c.pair_id, case when h.pair_id is null then c.target else h.target end as target, case when h.pair_id is null then c.status else 'translated' end as status from cat c left join hit h using (pair_id)""")
def catalog_after_updates(spark: SparkSession, base: str) -> DataFrame:
    cat = catalogue(spark, base, "doc_path lang ord id source target status")
    return C.with_edits(cat, _edits(cat)).select("pair_id", "target", "status")


@query(f"""with {CAT}, gaps as (select *, row_number() over (partition by doc_path, lang order by ord) - 1 as rn from (select *,
coalesce(last_value(case when not coalesce(frozen, false) then source end ignore nulls) over (partition by doc_path, lang order by ord rows between unbounded preceding and 1 preceding), '') as prev_source,
coalesce(first_value(case when not coalesce(frozen, false) then source end ignore nulls) over (partition by doc_path, lang order by ord rows between 1 following and unbounded following), '') as next_source from cat)
where not coalesce(frozen, false) and coalesce(target, '') = '' and source <> '')
select doc_path, lang, (rn // 20)::int as batch, sha256(to_json({{'items': list({{'id': id, 'kind': kind, 'source': source, 'prev_source': prev_source, 'next_source': next_source}} order by ord)}})) as payload from gaps group by all""")
def prompt_payloads(spark: SparkSession, base: str) -> DataFrame:
    made = P.payloads(catalogue(spark, base, "doc_path lang ord id kind frozen source target"), ["doc_path", "lang"])
    return made.withColumn("payload", F.sha2("payload", 256))


@query("""with d as (select path, sha256(coalesce(text, '')) as hash, fetched_at from documents where path is not null), lim as (select timestamp '2025-01-01' as t)
select path, hash from d, lim where fetched_at >= t and not exists (select 1 from d o, lim l where o.fetched_at < l.t and o.path = d.path and o.hash = d.hash) group by all""")
def incremental_changed_docs(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").filter("path is not null").select("path", F.sha2(T.text_or_empty(F.col("text")), 256).alias("hash"), "fetched_at")
    return C.changed_inputs(docs.filter("fetched_at < timestamp '2025-01-01'").select("path", "hash"), docs.filter("fetched_at >= timestamp '2025-01-01'").select("path", "hash")).distinct()


@query()
def id_reuse_greedy(spark: SparkSession, base: str) -> DataFrame:
    """Segments of every other language against the manifest of the English catalogue of the same pages, each language for itself; tested against a plain greedy match."""
    own = catalogue(spark, base, "doc_path lang ord id kind source fingerprint status").withColumnRenamed("source", "src_text")
    # A page in one language is a document of its own, so a language can't use up the ids of another.
    page = F.to_json(F.struct("doc_path", "lang"))
    new = own.filter("lang <> 'en'").withColumn("doc_path", page)
    pages = new.select("doc_path").distinct().withColumn("page", F.get_json_object("doc_path", "$.doc_path"))
    old = own.filter("lang = 'en'").withColumnRenamed("doc_path", "page").join(pages, "page").select(*[F.col(c).alias(c) for c in ("doc_path", "kind", "ord", "id", "fingerprint", "src_text")])
    reused = C.reuse_ids(new.select("doc_path", "kind", "ord", "id", "fingerprint", "src_text", "status"), old)
    return reused.select(F.get_json_object("doc_path", "$.doc_path").alias("doc_path"), F.get_json_object("doc_path", "$.lang").alias("lang"), "ord", "id", "status")
