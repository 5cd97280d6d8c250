"""Terms of a corpus and their glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words that are no terms, and what words and phrases look like.
STOP = (
    "und oder der die das ein eine einer eines mit für von auf im in zu den dem des "
    "the and or for with from into this that you your are is to of"
).split()
WORD = r"(?U)\b[A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß0-9_-]{2,}\b"
PHRASE = r"(?U)\b([A-ZÄÖÜ][\wÄÖÜäöüß-]+(?:\s+[A-ZÄÖÜ][\wÄÖÜäöüß-]+){1,4})\b"
UPPER = "[A-ZÄÖÜ]"


def word_score(w: Column) -> Column:
    inner = F.when(F.substring(w, 2, 1 << 20).rlike(UPPER), 2).otherwise(0)
    capitals = F.when((w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 2), 2).otherwise(0)
    joined = F.when(w.rlike("[-_]"), 1).otherwise(0)
    return F.lit(1) + inner + capitals + joined + F.when(F.length(w) > 10, 1).otherwise(0)


def term_scores(texts: DataFrame, text: str) -> DataFrame:
    """(term, score) over all texts. Words and phrases are cut out by two branches that share one aggregation."""
    phrases = texts.select(F.explode(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(1))).alias("term")).select(F.trim("term").alias("term"), F.lit(3).alias("score")).filter(F.length("term") > 4)
    words = texts.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("term")).filter(~F.lower("term").isin(*STOP)).select("term", word_score(F.col("term")).alias("score"))
    return phrases.unionByName(words).groupBy("term").agg(F.sum("score").alias("score"))


def top_terms(scores: DataFrame, k: int, least: int) -> DataFrame:
    """The k best, then those with at least ``least``; ties by term."""
    return scores.orderBy(F.desc("score"), "term").limit(k).filter(F.col("score") >= least)


def new_terms(terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """Glossary rows for terms it doesn't hold in any case; spellings that differ in case count once, the best."""
    known = glossary.select(F.lower("source").alias("low")).filter("low is not null").distinct()
    once = terms.withColumn("low", F.lower("term")).groupBy("low").agg(F.max(F.struct("score", "term")).alias("b"))
    fresh = once.join(known, "low", "left_anti")
    return fresh.select(F.col("b.term").alias("source"), F.lit("").alias("target"), F.concat(F.lit("candidate score "), F.col("b.score")).alias("note"))


def relevant_terms(texts: DataFrame, ident: str, text: str, glossary: DataFrame) -> DataFrame:
    """(ident, source, target, note): terms that stand as words in each text, whatever their case.

    Each text is cut into runs of words up to the longest term, and those are joined with the terms; no
    text meets a term it doesn't hold. A glossary row that repeats counts once.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    terms = glossary.filter("source <> ''").select("source", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("note", F.lit("")).alias("note")).distinct()
    terms = terms.withColumn("w", words(F.col("source"))).withColumn("n", F.size("w")).withColumn("key", F.array_join("w", " ")).filter("n > 0")
    sizes = sorted(r.n for r in terms.select("n").distinct().collect())  # a few small numbers
    if not sizes:
        return texts.limit(0).select(F.col(ident), F.lit("").alias("source"), F.lit("").alias("target"), F.lit("").alias("note"))
    low = texts.select(F.col(ident).alias("_id"), F.lower(F.col(text)).alias("_low"), words(F.col(text)).alias("_w"))

    def runs_of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - (n - 1))), lambda i: F.array_join(F.slice("_w", i, n), " "))
        return F.when(F.size("_w") >= n, made).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(n) for n in sizes]
    keyed = low.select("_id", "_low", F.explode(F.array_distinct(F.concat(*runs))).alias("key"))
    hit = keyed.join(terms, "key").filter(F.contains(F.col("_low"), F.lower(F.col("source"))))
    return hit.select(F.col("_id").alias(ident), "source", "target", "note")


def glossary_prompt(relevant: DataFrame, ident: str) -> DataFrame:
    """(ident, prompt): the lines that tell a translator which entries to respect, by source."""
    note = F.when(F.col("note") != "", F.concat(F.lit(" ("), F.col("note"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("source"), F.lit(" -> "), F.col("target"), note)
    lines = F.array_sort(F.collect_list(line))
    return relevant.groupBy(ident).agg(F.array_join(F.concat(F.array(F.lit("Glossary entries that must be respected:")), lines), "\n").alias("prompt"))


