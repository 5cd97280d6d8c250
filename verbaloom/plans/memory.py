"""Queries on the translation memory: lookups, upserts, history, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import similarity as S
from verbaloom.functions.similarity import usable
from verbaloom.operators import memory as M
from verbaloom.operators.catalogue import latest
from verbaloom.plans.common import CAT, MEM, REV, catalogue, memory, norm, query
from verbaloom.session import scratch, stored, table

ONE = "one as (select * from mem qualify row_number() over (partition by source_key, lang order by updated_at desc nulls last, entry_id desc) = 1)"


def _one(spark: SparkSession, base: str) -> DataFrame:
    return latest(memory(spark, base, "source_key lang target updated_at"), ["source_key", "lang"], ["updated_at", "entry_id"])


@query(f"with {CAT}, {MEM}, {ONE} select pair_id, o.target as tm_target, case when o.target is not null then 1.0::double end as tm_score from cat left join (select * from one where target <> '') o on o.source_key = sha256({norm('cat.source')}) and o.lang = cat.lang where cat.source is not null")
def tm_exact(spark: SparkSession, base: str) -> DataFrame:
    return M.exact(catalogue(spark, base, "source lang").filter("source is not null"), _one(spark, base)).select("pair_id", "tm_target", "tm_score")


@query(f"with {CAT}, {MEM}, {ONE} select pair_id from cat where source is not null and coalesce(target, '') = '' and not coalesce(frozen, false) and not exists (select 1 from one o where o.target <> '' and o.source_key = sha256({norm('cat.source')}) and o.lang = cat.lang)")
def tm_residual(spark: SparkSession, base: str) -> DataFrame:
    gaps = catalogue(spark, base, "source lang target frozen").filter("source is not null and coalesce(target, '') = '' and not coalesce(frozen, false)")
    return M.exact(gaps, _one(spark, base)).filter("tm_target is null").select("pair_id")


UPSERT = f"""with {MEM}, {REV}, new as (select r.source_key, m.source, r.target, r.lang, m.kind, m.segment_id, r.status, r.revised_at as updated_at, r.meta_json, null::float[] as embedding, null::varchar as embedding_backend, r.id as seq
  from rev r join (select distinct source_key, source, kind, segment_id, lang from mem) m on m.source_key = r.source_key and m.lang = r.lang where r.revised_at is not null and m.source <> '' and r.target <> ''),
al as (select source_key, source, target, lang, status, updated_at, embedding, 0 as n, entry_id as seq from mem union all select source_key, source, target, lang, status, updated_at, embedding, 1, seq from new),
w as (select *, row_number() over (partition by source_key, lang order by n desc, updated_at desc nulls last, seq desc) as rn, row_number() over (partition by source_key, lang order by n, updated_at nulls first, seq) as up from al)
select source_key, lang, max(case when up = 1 then source end) as source, max(case when rn = 1 then target end) as target, max(case when rn = 1 then status end) as status, max(case when rn = 1 then updated_at end) as updated_at, max(len(embedding)) as width from w group by source_key, lang"""


def _new(spark: SparkSession, base: str) -> DataFrame:
    rev = table(spark, base, "tm_revisions").dropDuplicates(["id"]).filter("revised_at is not null")
    known = memory(spark, base, "source_key lang source kind segment_id").select("source_key", "lang", "source", "kind", "segment_id").distinct()
    return rev.join(known, ["source_key", "lang"]).select(
        "source_key", "source", "target", "lang", "kind", "segment_id", "status", F.col("revised_at").alias("updated_at"), "meta_json",
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_backend"), F.col("id").alias("seq"),
    )


@query(UPSERT)
def tm_upsert_latest(spark: SparkSession, base: str) -> DataFrame:
    mem = memory(spark, base).withColumnRenamed("entry_id", "seq").drop("ingested_at")
    out = M.upsert(mem, _new(spark, base).select(*mem.columns))
    return out.select("source_key", "lang", "source", "target", "status", "updated_at", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("width"))


@query(f"with {REV} select id, source_key, lang, row_number() over (partition by source_key, lang order by revised_at desc nulls last, id desc) as rank from rev qualify rank <= 5")
def revision_history_topn(spark: SparkSession, base: str) -> DataFrame:
    return M.history(table(spark, base, "tm_revisions"), 5).select("id", "source_key", "lang", "rank")


@query(f"""with {MEM}, {REV}, k as (select segment_id, lang, source_key from mem where segment_id is not null qualify row_number() over (partition by segment_id, lang order by updated_at desc nulls last, source_key desc) = 1),
h as (select id, source_key, lang, row_number() over (partition by source_key, lang order by revised_at desc nulls last, id desc) as rank from rev qualify rank <= 8) select k.segment_id, h.id, h.rank from k join h on h.source_key = k.source_key and h.lang = k.lang""")
def segment_history(spark: SparkSession, base: str) -> DataFrame:
    return M.segment_history(memory(spark, base, "segment_id lang source_key updated_at"), table(spark, base, "tm_revisions"), 8).select("segment_id", "id", "rank")


@query(f"with {REV} select coalesce(author, 'unknown') as author, count(*) as n, count(distinct source_key) as texts from rev group by 1")
def revisions_by_author(spark: SparkSession, base: str) -> DataFrame:
    rev = table(spark, base, "tm_revisions").dropDuplicates(["id"])
    return rev.groupBy(F.coalesce("author", F.lit("unknown")).alias("author")).agg(F.count("*").alias("n"), F.countDistinct("source_key").alias("texts"))


@query(f"""with {REV}, o as (select * from rev where revised_at < timestamp '2025-01-01'), n as (select * from rev where revised_at >= timestamp '2025-01-01'),
last as (select * from o qualify row_number() over (partition by source_key, lang order by revised_at desc, id desc) = 1)
select n.id from n left join last l on l.source_key = n.source_key and l.lang is not distinct from n.lang where not (l.id is not null and l.target is not distinct from n.target and l.status is not distinct from n.status)""")
def revisions_to_append(spark: SparkSession, base: str) -> DataFrame:
    rev = table(spark, base, "tm_revisions").dropDuplicates(["id"])
    new = rev.filter("revised_at >= timestamp '2025-01-01'").withColumnRenamed("revised_at", "updated_at").withColumn("meta_json", F.to_json(F.struct("id")))
    made = M.new_revisions(rev.filter("revised_at < timestamp '2025-01-01'"), new)
    return made.select(F.get_json_object("meta_json", "$.id").cast("long").alias("id"))


VECS = f"{MEM}, v as (select entry_id, embedding from mem where len(embedding) = 96 and list_count(embedding) = 96 and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"


@query(f"""with {VECS}, c as (select a.entry_id as query_id, b.entry_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from v a join v b on a.entry_id % 50 = 0 and a.entry_id <> b.entry_id)
select query_id, entry_id, round(s, 6) as cosine, row_number() over (partition by query_id order by s desc, entry_id) as rank from c qualify rank <= 5""")
def cosine_topk(spark: SparkSession, base: str) -> DataFrame:
    """The stated queries (ids divisible by 50) against all rows, exactly, in blocks of products."""
    return M.exact_nearest(memory(spark, base, "embedding"), "entry_id", "embedding", 5, 96, every=50).select("query_id", "entry_id", F.round("cosine", 6).alias("cosine"), "rank")


TOKENS = lambda c: f"list_distinct(list_filter(string_split(lower({norm(c)}), ' '), lambda w: w <> ''))"


@query(f"""with {MEM}, t as (select entry_id, lang, {TOKENS('source')} as w from mem where source is not null and lang is not null),
c as (select a.entry_id as query_id, b.entry_id, len(list_intersect(a.w, b.w)) as n, len(a.w) as x, len(b.w) as y from t a join t b on a.lang = b.lang and a.entry_id % 50 = 0 and a.entry_id <> b.entry_id)
select query_id, entry_id, n as shared, x + y - n as together from c where n > 0 and 3 * n >= x + y - n""")
def token_jaccard(spark: SparkSession, base: str) -> DataFrame:
    return M.by_words(memory(spark, base, "source lang"), 1, 3, every=50)


def _sides(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    mem = memory(spark, base, "source lang updated_at").filter("source is not null")
    return mem.filter("entry_id % 50 = 0").withColumnRenamed("entry_id", "query_id"), mem


@query()
def tm_fuzzy_lexical(spark: SparkSession, base: str) -> DataFrame:
    """Tested against a plain comparison of all pairs; the ratio has no SQL."""
    q, mem = _sides(spark, base)
    return M.fuzzy_lexical(q, mem, 0.82, 3)


@query()
def tm_fuzzy_hybrid(spark: SparkSession, base: str) -> DataFrame:
    """Tested against a plain comparison of all pairs; the ratio has no SQL."""
    q, mem = _sides(spark, base)
    return M.fuzzy_hybrid(q.withColumn("vector", S.hashed_vectors("source")), mem.withColumn("vector", S.hashed_vectors("source")), 0.82, 3)


@query(f"""with {VECS}, l as (select v.*, m.lang from v join mem m using (entry_id) where m.lang is not null), c as (select a.entry_id as query_id, b.entry_id, b.lang, round(greatest(0, least(1, list_dot_product(a.embedding::double[], b.embedding::double[]))), 4) as score, m.updated_at from l a join l b on a.lang = b.lang and a.entry_id % 50 = 0 and a.entry_id <> b.entry_id join mem m on m.entry_id = b.entry_id)
select query_id, entry_id, score, row_number() over (partition by query_id order by score desc, updated_at desc nulls last, entry_id) as rank from c where score >= 0.82 qualify rank <= 3""")
def tm_fuzzy_vector(spark: SparkSession, base: str) -> DataFrame:
    """By the vectors alone; queries are the ids divisible by 50."""
    mem = memory(spark, base, "lang updated_at embedding").filter(usable("embedding", 96)).withColumnRenamed("embedding", "vector")
    return M.fuzzy_vector(mem.filter("entry_id % 50 = 0").withColumnRenamed("entry_id", "query_id"), mem, 0.82, 3)


@query()
def tm_suggestions(spark: SparkSession, base: str) -> DataFrame:
    """By the ratio of matching characters in any language; queries are the ids divisible by 50. Tested against all pairs; the ratio has no SQL."""
    mem = memory(spark, base, "source").filter("source is not null")
    return M.fuzzy_ratio(mem.filter("entry_id % 50 = 0").withColumnRenamed("entry_id", "query_id"), mem, 0.75, 5)


@query()
def tm_prefill(spark: SparkSession, base: str) -> DataFrame:
    """Every missing target from the memory, exact before fuzzy. Tested against a plain search; the ratio has no SQL."""
    one = stored(latest(memory(spark, base, "source_key lang source target updated_at").filter("source is not null"), ["source_key", "lang"], ["updated_at", "entry_id"]), "memory")
    segs = catalogue(spark, base, "source lang target status meta frozen")
    return M.prefill(segs, one.withColumn("vector", S.hashed_vectors("source")), "pair_id", 0.82)


@query(f"with {MEM} select entry_id, row_number() over (partition by lang order by updated_at desc nulls last, entry_id) as rank from mem qualify rank <= 10000")
def tm_recent(spark: SparkSession, base: str) -> DataFrame:
    return M.recent(memory(spark, base, "lang updated_at")).select("entry_id", "rank")


@query(f"with {MEM} select entry_id, 4 * len(embedding) as bytes, true as same from mem where len(embedding) > 0")
def vector_pack(spark: SparkSession, base: str) -> DataFrame:
    """Vectors packed to bytes and unpacked again."""
    rows = memory(spark, base, "embedding").filter(F.size("embedding") > 0).withColumn("p", S.packed("embedding"))
    return rows.select("entry_id", F.octet_length("p").cast("long").alias("bytes"), (S.unpacked("p") == F.col("embedding")).alias("same"))


@query()
def hash_vectors(spark: SparkSession, base: str) -> DataFrame:
    return memory(spark, base, "source").select("entry_id", S.hashed_vectors("source").alias("vector"))


@query(f"with {MEM} select entry_id, coalesce(len(embedding), 96)::int as width, case when embedding is null then 'hash-ngram' else embedding_backend end as embedding_backend from mem")
def tm_backfill(spark: SparkSession, base: str) -> DataFrame:
    return M.backfill(memory(spark, base, "source embedding embedding_backend")).select("entry_id", F.size("embedding").alias("width"), "embedding_backend")


@query(f"with {REV} select source_key, lang, id, status from rev where source_key is not null qualify row_number() over (partition by source_key, lang order by revised_at desc nulls last, id desc) = 1")
def stream_revision_latest(spark: SparkSession, base: str) -> DataFrame:
    """The revisions as a stream of files; the table it leaves equals the batch result."""
    from verbaloom.streaming import watch

    root, keys, by = scratch(spark, "stream"), ["source_key", "lang"], ["revised_at", "id"]
    batch = table(spark, base, "tm_revisions")
    stream = spark.readStream.schema(batch.schema).parquet(f"{base.rstrip('/')}/tm_revisions.parquet*").filter("source_key is not null").select("source_key", "lang", "revised_at", "id", "status")
    watch.latest_state(stream, f"{root}/table", f"{root}/checkpoint", keys, by).awaitTermination()
    return watch.state(spark, f"{root}/table", keys, by).select("source_key", "lang", "id", "status")
