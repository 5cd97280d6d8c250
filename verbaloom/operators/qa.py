"""Checks of translations, conservative repairs, visual checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verbaloom.functions import jsonish as J
from verbaloom.functions import markup as M
from verbaloom.functions import text as T

#: Forms of informal address, and shares of length that look wrong.
INFORMAL = r"(?iU)\b(du|dir|dein|dich|euch|ihr)\b"
PRODUCT = r"(?U)\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b"
LONGEST, SHORTEST, LEAST_LENGTH = 1.5, 0.45, 20


def rules(source: Column, target: Column) -> Column:
    """The codes of the rules a pair breaks, in order; none for a null or empty target.

    L1 number of links, L2 else their addresses, L3 number of images, L4 else their addresses, L5 number of
    code spans, L6 much longer, L7 much shorter, L8 placeholders, L9 tags of components.
    """
    ls, lt, im_s, im_t = M.link_urls(source), M.link_urls(target), M.image_urls(source), M.image_urls(target)
    s, t = F.length(T.text_or_empty(source)), F.length(T.text_or_empty(target))
    found = [
        ("L1", F.size(ls) != F.size(lt)),
        ("L2", (F.size(ls) == F.size(lt)) & (ls != lt)),
        ("L3", F.size(im_s) != F.size(im_t)),
        ("L4", (F.size(im_s) == F.size(im_t)) & (im_s != im_t)),
        ("L5", F.size(M.code_spans(source)) != F.size(M.code_spans(target))),
        ("L6", (s > LEAST_LENGTH) & (t > s * LONGEST)),
        ("L7", (s > LEAST_LENGTH) & (t < s * SHORTEST)),
        ("L8", M.placeholders(source) != M.placeholders(target)),
        ("L9", M.tags(source) != M.tags(target)),
    ]
    broken = F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in found)))
    return F.when(T.text_or_empty(target) == "", F.array().cast("array<string>")).otherwise(broken)


def lintable(catalogue: DataFrame) -> DataFrame:
    return catalogue.filter(~F.coalesce("frozen", F.lit(False)) & (T.text_or_empty(F.col("target")) != ""))


def lint(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule): one row for each broken rule of each segment."""
    return lintable(catalogue).select(*keys, F.explode(rules(F.col("source"), F.col("target"))).alias("rule"))


def _listed(values: Column) -> Column:
    """An array of strings as a list in single quotes; in double ones where a value holds a single quote only."""
    safe = lambda v: F.replace(v, F.lit("\\"), F.lit("\\\\"))
    single, double = F.lit("'"), F.lit('"')
    quoted = lambda v: F.when(~F.contains(v, single), F.concat(single, safe(v), single)).when(~F.contains(v, double), F.concat(double, safe(v), double)).otherwise(F.concat(single, F.replace(safe(v), single, F.lit("\\'")), single))
    return F.concat(F.lit("["), F.array_join(F.transform(values, quoted), ", "), F.lit("]"))


def message(rule: Column, source: Column, target: Column) -> Column:
    """What a broken rule says, with the numbers or lists it compares."""
    both = lambda head, of, tail="": F.concat(F.lit(f"{head}source="), of(source), F.lit(" target="), of(target), F.lit(tail))
    lengths = lambda head, tail: F.concat(F.lit(f"{head}source_len="), F.length(source), F.lit(" target_len="), F.length(target), F.lit(tail))
    size = lambda f: lambda c: F.size(f(c)).cast("string")
    said = {
        "L1": both("Markdown link count changed: ", size(M.link_urls)), "L2": F.lit("Markdown link URLs changed."), "L3": both("Image count changed: ", size(M.image_urls)), "L4": F.lit("Image URLs changed."),
        "L5": both("Inline code span count changed: ", size(M.code_spans)), "L6": lengths("Text expansion > 50%: ", ". UI layout might break."), "L7": lengths("Text contraction > 55%: ", ". Meaning may be missing."),
        "L8": both("Placeholder mismatch: ", lambda c: _listed(M.placeholders(c))), "L9": both("JSX/MDX tag mismatch: ", lambda c: _listed(M.tags(c))),
    }
    out = F.lit(None).cast("string")
    for code, text in said.items():
        out = F.when(rule == code, text).otherwise(out)
    return out


def issues(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, kind, source, target, level, rule, message): one row for each broken rule of each segment."""
    cols = list(dict.fromkeys([*keys, "id", "kind", "source", "target"]))
    rows = lintable(catalogue).select(*cols, F.explode(rules(F.col("source"), F.col("target"))).alias("rule"))
    return rows.select(*cols, F.lit("warn").alias("level"), "rule", message(F.col("rule"), T.text_or_empty(F.col("source")), F.col("target")).alias("message"))


def format_issue(level: Column, ident: Column, kind: Column, said: Column, source: Column, target: Column) -> Column:
    """Four lines; nulls count as empty."""
    e = T.text_or_empty
    return F.concat(F.lit("["), F.upper(level), F.lit("] token="), e(ident), F.lit(" kind="), e(kind), F.lit("\n       "), e(said), F.lit("\n       Source: "), e(source), F.lit("\n       Target: "), e(target))


def format_visual(page: Column, token: Column, tag: Column, chars: Column, most: Column, text: Column) -> Column:
    """The message of a block with more visible characters than fit, with the first 240 of its text."""
    said = F.concat(F.lit("Potential overflow: <"), tag, F.lit("> has "), chars.cast("string"), F.lit(" visible chars (limit "), most.cast("string"), F.lit(")."))
    return F.concat(F.lit("[VISUAL-WARN] "), page, F.lit(" token="), token, F.lit("\n       "), said, F.lit("\n       Text: "), F.substring(text, 1, 240))


def model_issues(catalogue: DataFrame, replies: DataFrame, reply: str) -> DataFrame:
    """(id, kind, level, message, source, target) of what a model reports: JSON lists of {id, level, message or rule_violated}, perhaps fenced.

    Ids that no lintable segment has are dropped, as are replies that aren't JSON; of entries with one id the last counts.
    """
    item = "array<struct<id:string,level:string,message:string,rule_violated:string>>"
    found = replies.select(F.explode(F.from_json(J.parseable(F.col(reply)), item)).alias("i")).select("i.*")
    own = lintable(catalogue).groupBy("id").agg(F.max_by(F.struct("kind", "source", "target"), F.struct("ord", "kind", "source", "target")).alias("e"))
    said = F.coalesce(F.nullif("message", F.lit("")), "rule_violated", F.lit("AI semantic warning"))
    return found.join(own, "id").select("id", "e.kind", F.coalesce("level", F.lit("ai-warn")).alias("level"), said.alias("message"), "e.source", "e.target")


def tone(catalogue: DataFrame, keys: list[str], style: str) -> DataFrame:
    """(keys, word): informal address where the style guide asks for formal address."""
    formal = "Sie" in style or "formal" in style.lower() or "förmlich" in style.lower()
    found = lintable(catalogue).filter(F.col("target").rlike(INFORMAL)) if formal else lintable(catalogue).limit(0)
    return found.select(*keys, F.lower(F.regexp_extract("target", INFORMAL, 1)).alias("word"))


def lost_products(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, product): names with inner capitals that the target lacks, as often as they occur."""
    names = F.filter(F.regexp_extract_all("source", F.lit(PRODUCT), F.lit(0)), lambda p: ~F.contains(F.col("target"), p))
    return lintable(catalogue).select(*keys, F.explode(names).alias("product"))


@F.pandas_udf(StringType())
def with_source_urls(source: pd.Series, target: pd.Series) -> pd.Series:
    """The target with the source's addresses put into its links by position, if there are as many."""
    link = re.compile(M.LINK)
    out = []
    for s, t in zip(source.fillna(""), target.fillna(""), strict=True):
        urls = [m.group(2).strip() for m in link.finditer(s)]
        if urls and len(urls) == len(link.findall(t)):
            left = iter(urls)
            t = link.sub(lambda m, left=left: f"[{m.group(1)}]({next(left)})", t)
        out.append(t)
    return pd.Series(out)


def with_meta(meta: Column, extra: Column) -> Column:
    """A JSON object with the members of another behind its own; anything but an object counts as empty."""
    own = F.when(T.text_or_empty(meta).rlike(r"(?s)^\s*\{.*\}\s*$") & J.valid(meta), F.regexp_extract(meta, r"(?s)^\s*\{(.*)\}\s*$", 1)).otherwise("")
    inner = F.regexp_extract(extra, r"(?s)^\{(.*)\}$", 1)
    return F.concat(F.lit("{"), own, F.when(F.trim(own) == "", "").otherwise(", "), inner, F.lit("}"))


def repaired(catalogue: DataFrame) -> DataFrame:
    """catalogue's lintable rows that a repair changes, with ``fixed``, ``notes`` on what was done, and status needs_review.

    Addresses are put back by position if there are as many links; then come the links (if all are gone), the images
    (if all are gone), code spans, placeholders and tags that are lacking. A column ``meta`` (JSON) is noted down too.
    Every list is a column of its own, so that each is computed once.
    """
    c, note = F.col, F.lit
    suffix = lambda text, xs: F.aggregate(xs, text, lambda acc, x: F.concat(acc, F.lit(" "), x))
    lacking = lambda of, text: F.filter(of, lambda x: ~F.array_contains(text, x))
    step = lintable(catalogue).withColumns({"_t0": with_source_urls("source", "target"), "_labels": M.link_labels(c("source")), "_urls": M.link_urls(c("source")), "_alts": M.image_labels(c("source")), "_pics": M.image_urls(c("source"))})
    step = step.withColumns({"_n0": F.when(c("_t0") != c("target"), F.array(note("restored markdown link URLs"))), "_gone": (F.size("_urls") > 0) & (F.size(M.link_urls(c("_t0"))) == 0)})
    links = F.array_join(F.zip_with("_labels", "_urls", lambda x, u: F.concat(F.lit("["), x, F.lit("]("), u, F.lit(")"))), " ")
    step = step.withColumn("_t1", F.when(c("_gone"), F.concat(c("_t0"), F.lit(" "), links)).otherwise(c("_t0")))
    images = F.array_join(F.zip_with("_alts", "_pics", lambda x, u: F.concat(F.lit("!["), x, F.lit("]("), u, F.lit(")"))), "\n")
    step = step.withColumn("_blind", (F.size("_pics") > 0) & (F.size(M.image_urls(c("_t1"))) == 0))
    step = step.withColumn("_t2", F.when(c("_blind"), F.concat(c("_t1"), F.lit("\n\n"), images)).otherwise(c("_t1")))
    step = step.withColumn("_codes", F.transform(F.array_except(M.code_spans(c("source")), M.code_spans(c("_t2"))), lambda x: F.concat(F.lit("`"), x, F.lit("`"))))
    step = step.withColumn("_t3", suffix(c("_t2"), c("_codes"))).withColumn("_holes", F.array_except(M.placeholders(c("source")), M.placeholders(c("_t3"))))
    step = step.withColumn("_t4", suffix(c("_t3"), c("_holes"))).withColumn("_tags", lacking(M.tags(c("source")), M.tags(c("_t4"))))
    each = lambda name, head: F.transform(name, lambda x: F.concat(F.lit(head), x))
    notes = F.flatten(F.array_compact(F.array(
        c("_n0"), F.when(c("_gone"), F.array(note("reinserted missing markdown links"))), F.when(c("_blind"), F.array(note("reinserted missing images"))),
        each("_codes", "reinserted inline code "), each("_holes", "reinserted placeholder "), each("_tags", "reinserted JSX tag "),
    )))
    done = step.withColumns({"fixed": F.trim(suffix(c("_t4"), c("_tags"))), "notes": notes}).filter((F.size("notes") > 0) & (c("fixed") != c("target")))
    done = done.withColumn("status", F.lit("needs_review")).drop(*(x for x in done.columns if x.startswith("_")))
    if "meta" in done.columns:
        done = done.withColumn("meta", with_meta(c("meta"), F.to_json(F.struct(F.lit(True).alias("auto_fixed"), c("notes").alias("auto_fix_notes")))))
    return done


def visual(blocks: DataFrame, *keep: str) -> DataFrame:
    """(keep, token, tag, chars, most, shown): blocks (token, tag, text) with more visible characters than fit; shown is the visible text."""
    shown = F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", ""), r"\s+", " "))
    tag = F.lower("tag")
    most = F.when(F.startswith(tag, F.lit("h")), 120).when(tag.isin("td", "th"), 80).otherwise(240)
    return blocks.select(*keep, "token", tag.alias("tag"), F.length(shown).alias("chars"), most.alias("most"), shown.alias("shown")).filter("chars > most")


#: Fixed value: how a rendered block names its segment.
BLOCK = r"""(?is)<([a-z0-9]+)[^>]*data-token="([^"]+)"[^>]*>(.*?)</\1>"""


def token_blocks(pages: DataFrame, html: str) -> DataFrame:
    """(token, tag, text) of the blocks of rendered pages that carry a segment id; nested ones count with the outer."""
    parts = [F.regexp_extract_all(html, F.lit(BLOCK), F.lit(g)) for g in (2, 1, 3)]
    return pages.select(F.explode(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("token", "tag", "text"), strict=True)))).alias("b")).select("b.*")
