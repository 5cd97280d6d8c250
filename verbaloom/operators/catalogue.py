"""Catalogues of segments: latest deliveries, joins with older states, roll-ups of status."""

from __future__ import annotations

import difflib
import html
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.functions import text as T


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row by key: the last by ``by`` (nulls first), ties by all other columns.

    A partial aggregate runs before the shuffle, so a key that holds much of the table is no hot task.
    """
    rest = [c for c in df.columns if c not in keys]
    # Maps can't be compared; every other type can.
    best = F.max(F.struct(*by, *[c for c in rest if c not in by])).alias("_last")
    return df.groupBy(*keys).agg(best).select(*[F.col(k) if k in keys else F.col(f"_last.{k}").alias(k) for k in df.columns])


def state(frozen: str = "frozen", status: str = "status", target: str = "target") -> Column:
    """Frozen before needs_review before translated (a target) before missing."""
    said = F.lower(F.trim(T.text_or_empty(F.col(status))))
    return (
        F.when(F.coalesce(F.col(frozen), F.lit(False)), "frozen")
        .when(said == "needs_review", "needs_review")
        .when(T.text_or_empty(F.col(target)) != "", "translated")
        .otherwise("missing")
    )


COUNTED = ("translated", "missing", "needs_review", "frozen")


def counts() -> list[Column]:
    return [F.count_if(F.col("state") == s).alias(s) for s in COUNTED] + [F.count("*").alias("total")]


def status_summary(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    return catalogue.withColumn("state", state()).groupBy(*keys).agg(*counts())


def status_grouping_sets(catalogue: DataFrame) -> DataFrame:
    """By page and language, by language, and over all."""
    named = catalogue.withColumn("state", state())
    return named.groupingSets([["doc_path", "lang"], ["lang"], []], "doc_path", "lang").agg(*counts(), F.grouping_id().alias("level"))


def pages_with_status(pages: DataFrame, catalogue: DataFrame, lang: str) -> DataFrame:
    """Every page, also those without a catalogue in the language (``has_catalogue`` false, counts 0)."""
    own = status_summary(catalogue.filter(F.col("lang") == lang), ["doc_path"])
    joined = pages.select(F.col("source").alias("doc_path")).filter("doc_path is not null").distinct().join(own, "doc_path", "left")
    return joined.select("doc_path", F.col("total").isNotNull().alias("has_catalogue"), *[F.coalesce(c, F.lit(0)).alias(c) for c in (*COUNTED, "total")])


def attention(summary: DataFrame, issues: DataFrame | None, k: int) -> DataFrame:
    """The k pages with most missing, to be reviewed or with issues; ties by path."""
    both = summary if issues is None else summary.join(issues, "doc_path", "left")
    found = F.lit(0) if issues is None else F.coalesce("lint_issues", F.lit(0))
    return both.withColumn("lint_issues", found).withColumn("attention", F.col("missing") + F.col("needs_review") + F.col("lint_issues")).orderBy(F.desc("attention"), "doc_path").limit(k)


def percentages(summary: DataFrame) -> DataFrame:
    """Shares of the whole, unrounded; a page without segments has 0."""
    return summary.select("*", *[(F.col(c) * 100.0 / F.greatest(F.lit(1), F.col("total"))).alias(f"{c}_pct") for c in COUNTED])


def ci_report(pages: DataFrame) -> DataFrame:
    """(doc_path, line) for each page and a last line with the totals; a missing catalogue counts as one missing."""
    line = F.when(~F.col("has_catalogue"), F.format_string("- `%s`: catalog missing", "doc_path")).otherwise(
        F.format_string("- `%s`: %d translated, %d missing, %d needs_review, %d total", "doc_path", "translated", "missing", "needs_review", "total")
    )
    missing = F.sum(F.when(F.col("has_catalogue"), F.col("missing")).otherwise(1)).alias("missing")
    whole = pages.agg(F.sum("translated").alias("translated"), missing, F.sum("needs_review").alias("needs_review"), F.sum("total").alias("total"))
    last = whole.select(F.lit(None).cast("string").alias("doc_path"), F.format_string("**Summary:** %d translated, %d missing, %d needs_review, %d total.", *[F.coalesce(c, F.lit(0)) for c in ("translated", "missing", "needs_review", "total")]).alias("line"))
    return pages.select("doc_path", line.alias("line")).unionByName(last)


def unfinished(summary: DataFrame) -> DataFrame:
    """(lang, failing): whether a strict check of the language fails."""
    return summary.groupBy("lang").agg(F.coalesce(F.bool_or((F.col("missing") > 0) | (F.col("needs_review") > 0)), F.lit(False)).alias("failing"))


def needs_translation(catalogue: DataFrame) -> DataFrame:
    return catalogue.filter(~F.coalesce("frozen", F.lit(False)) & (T.text_or_empty(F.col("target")) == ""))


def merge_targets(segs: DataFrame, catalogue: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Targets and status of the last entry with a segment's id; segments without one stay as they are. keys: what must be equal besides, such as the language."""
    old = catalogue.groupBy(*keys, "id").agg(F.max_by(F.struct("target", "status"), "ord").alias("e"))
    joined = segs.join(old, [*keys, "id"], "left")
    target = F.when(F.col("e").isNotNull(), T.text_or_empty(F.col("e.target"))).otherwise(F.col("target"))
    status = (
        F.when(F.col("e").isNull(), F.col("status"))
        .when((F.col("status") == "needs_review") | (F.col("e.status") == "needs_review"), "needs_review")
        .when(T.text_or_empty(F.col("e.target")) != "", "translated")
        .otherwise(F.col("status"))
    )
    return joined.select(*[status.alias("status") if c == "status" else target.alias("target") if c == "target" else F.col(c) for c in segs.columns])


def edited(catalogue: DataFrame, edits: DataFrame) -> DataFrame:
    """The entries that edits (id, lang, target, status) reach, with the new target and status: in each document the first with the id.

    status null means translated; of edits to one id and language the last by (target, status) counts; ids that aren't there do nothing.
    """
    one = edits.filter("id is not null").groupBy("id", "lang").agg(F.max(F.struct(F.col("target"), F.coalesce("status", F.lit("translated")).alias("status"))).alias("e"))
    first = catalogue.join(one, ["id", "lang"]).groupBy("doc_path", "lang", "id", "e").agg(F.min("ord").alias("ord"))
    hit = catalogue.join(first, ["doc_path", "lang", "id", "ord"])
    return hit.select(*[F.col(f"e.{c}").alias(c) if c in ("target", "status") else F.col(c) for c in catalogue.columns])


def with_edits(catalogue: DataFrame, edits: DataFrame) -> DataFrame:
    """catalogue after the edits; every other entry stays as it is."""
    new = edited(catalogue, edits).select("doc_path", "lang", "id", "ord", F.struct(F.col("target"), F.col("status")).alias("_e")).distinct()
    joined = catalogue.join(new, ["doc_path", "lang", "id", "ord"], "left")
    return joined.select(*[F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) if c in ("target", "status") else F.col(c) for c in catalogue.columns])


def resolved(target: str, own: str, source: str) -> Column:
    """The first of the three that isn't empty."""
    return F.coalesce(F.nullif(F.col(target), F.lit("")), F.nullif(F.col(own), F.lit("")), F.col(source))


def sync_targets(to: DataFrame, frm: DataFrame) -> DataFrame:
    """Fill empty targets by the last finished entry with the same fingerprint in the same document."""
    usable = frm.filter("fingerprint is not null and target <> '' and status in ('translated', 'needs_review')")
    best = usable.groupBy("doc_path", "fingerprint").agg(F.max_by(F.struct("target", "id"), F.struct("ord", "id")).alias("hit"))
    gaps = needs_translation(to)
    return gaps.join(best, ["doc_path", "fingerprint"]).select("doc_path", "id", F.col("hit.target").alias("target"), F.lit("translated").alias("status"), F.col("hit.id").alias("synced_from_id"))


def neighbours(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """prev_source and next_source: the nearest segments before and after that aren't frozen; empty at the ends."""
    w = Window.partitionBy(*keys).orderBy("ord")
    free = F.when(~F.coalesce("frozen", F.lit(False)), F.col("source"))
    before = F.last(free, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(free, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return catalogue.select("*", T.text_or_empty(before).alias("prev_source"), T.text_or_empty(after).alias("next_source"))


def dashboard(pages: DataFrame, lang: str) -> str:
    """An HTML page of the roll-up (attention's rows, ``k`` of them at most, are collected): totals, shares and one row by page."""
    rows = pages.collect()
    share = lambda n, of: 0.0 if not of else round(100 * n / of, 1)
    whole = {c: sum(r[c] for r in rows) for c in ("translated", "needs_review", "missing", "lint_issues", "total")}
    cards = "".join(f"<dt>{name}</dt><dd>{share(whole[c], whole['total'])}%</dd>" for name, c in (("Translated", "translated"), ("Needs review", "needs_review"), ("Missing", "missing")))
    cells = lambda r: "".join(f"<td>{r[c]}</td>" for c in ("translated", "needs_review", "missing", "lint_issues"))
    body = "\n".join(f"<tr><td><code>{html.escape(r.doc_path or '')}</code></td>{cells(r)}<td><meter max='100' value='{share(r.translated, r.total)}'></meter></td></tr>" for r in rows)
    data = html.escape(json.dumps({"lang": lang, "total": whole, "pages": [r.asDict() for r in rows]}, ensure_ascii=False))
    head = "<tr><th>Page</th><th>Translated</th><th>Review</th><th>Missing</th><th>QA</th><th>Progress</th></tr>"
    return (
        f"<!doctype html>\n<html lang='en'><head><meta charset='utf-8'><title>Localization</title></head><body>\n<h1>Localization: {html.escape(lang)}</h1>\n"
        f"<dl>{cards}<dt>QA warnings</dt><dd>{whole['lint_issues']}</dd></dl>\n<table><thead>{head}</thead><tbody>\n{body}\n</tbody></table>\n<script type='application/json'>{data}</script>\n</body></html>\n"
    )


def changed_inputs(old: DataFrame, new: DataFrame, old_globals: DataFrame | None = None, new_globals: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` (path, hash) to build again: all if a global input changed, else those not in ``old``."""
    fresh = new.join(old, [new.path == old.path, new.hash.eqNullSafe(old.hash)], "left_anti")
    if old_globals is None or new_globals is None:
        return fresh
    differs = new_globals.join(old_globals, ["path", "hash"], "left_anti").unionByName(old_globals.join(new_globals, ["path", "hash"], "left_anti")).limit(1).select(F.lit(True).alias("all"))
    return fresh.unionByName(new.join(F.broadcast(differs)).drop("all")).distinct()


def reuse_ids(segs: DataFrame, manifest: DataFrame, least: float = 0.88) -> DataFrame:
    """Ids of the most similar unused old node of the same document and kind, in segment order.

    The match depends on the order, so each (document, kind) is one task; kinds are independent. Both sides
    are pruned by length before the ratio is taken. Segments without a match keep id and status.
    """
    new = segs.select("doc_path", "kind", "ord", "id", "fingerprint", T.normalised(F.col("src_text")).alias("norm"))
    old = manifest.select("doc_path", "kind", "ord", "id", "fingerprint", T.normalised(F.col("src_text")).alias("norm"))

    def match(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("ord")
        olds = [(r.id, r.fingerprint, r.norm or "") for r in right.itertuples()]
        same: dict[str, list[int]] = {}
        for k, o in enumerate(olds):
            same.setdefault(o[2], []).append(k)
        used: set[str] = set()
        rows = []
        for s in left.sort_values("ord").itertuples():
            text = s.norm or ""
            best, top = None, 0.0
            exact = next((olds[k] for k in same.get(text, ()) if olds[k][0] not in used), None)
            if exact is not None:
                best, top = exact, 1.0  # nothing is more similar, and the first of equals wins
            else:
                match_ = difflib.SequenceMatcher(None, text, "")
                for o in olds:
                    a, b = len(text), len(o[2])
                    if o[0] in used or 2.0 * min(a, b) < max(least, top) * (a + b):
                        continue
                    match_.set_seq2(o[2])
                    if match_.real_quick_ratio() >= least and match_.quick_ratio() >= least and (r := match_.ratio()) > top:
                        best, top = o, r
            if best is not None and top >= least:
                used.add(best[0])
                rows.append((*key, s.ord, best[0], "current" if best[1] == s.fingerprint else "needs_review"))
        return pd.DataFrame(rows, columns=["doc_path", "kind", "ord", "reused", "new_status"])

    found = new.groupBy("doc_path", "kind").cogroup(old.groupBy("doc_path", "kind")).applyInPandas(match, "doc_path string, kind string, ord int, reused string, new_status string")
    joined = segs.join(found, ["doc_path", "kind", "ord"], "left")
    return joined.select(*[F.coalesce("reused", "id").alias("id") if c == "id" else F.coalesce("new_status", "status").alias("status") if c == "status" else F.col(c) for c in segs.columns])


