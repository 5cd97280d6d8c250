import difflib
import random

from pyspark.sql import functions as F

from verbaloom.operators import catalogue as C
from verbaloom.operators import plugins as P

SEG = "doc_path string, lang string, ord int, id string, kind string, source string, target string, frozen boolean, fingerprint string, status string"


def seg(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], SEG)


def test_latest_takes_the_last_with_nulls_first(spark, rows):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d"), (None, 1, "e")], "k int, t int, v string")
    assert rows(C.latest(df, ["k"], ["t"])) == [(1, 2, "c"), (2, None, "d"), (None, 1, "e")]
    assert C.latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_status_precedence(spark):
    df = seg(spark, ("a", "de", 0, "1", "p", "s", "t", True, "f", "needs_review"), ("a", "de", 1, "2", "p", "s", "t", False, "f", " Needs_Review "), ("a", "de", 2, "3", "p", "s", "t", None, "f", None), ("a", "de", 3, "4", "p", "s", "", False, "f", "translated"), ("a", "de", 4, "5", "p", "s", None, False, "f", "new"))
    r = C.status_summary(df, ["doc_path"]).first()
    assert (r.frozen, r.needs_review, r.translated, r.missing, r.total) == (1, 1, 1, 2, 5)
    whole = C.status_grouping_sets(df).filter("level = 3").first()
    assert whole.total == 5 and whole.doc_path is None
    assert C.unfinished(C.status_summary(df, ["doc_path", "lang"])).first().failing


def test_pages_without_catalogue(spark):
    pages = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "source string")
    df = seg(spark, ("a", "en", 0, "1", "p", "s", "t", False, "f", "new"))
    got = {r.doc_path: r for r in C.pages_with_status(pages, df, "en").collect()}
    assert got["a"].translated == 1 and not got["b"].has_catalogue and len(got) == 2
    lines = {r.doc_path: r.line for r in C.ci_report(C.pages_with_status(pages, df, "en")).collect()}
    assert lines["b"] == "- `b`: catalog missing" and lines[None] == "**Summary:** 1 translated, 1 missing, 0 needs_review, 1 total."


def test_merge_targets_last_duplicate_wins(spark):
    new = seg(spark, ("a", "de", 0, "1", "p", "s", "", False, "f", "new"), ("a", "de", 1, "2", "p", "s", "", False, "f", "needs_review"), ("a", "de", 2, "9", "p", "s", "", False, "f", "new"))
    old = seg(spark, ("a", "de", 0, "1", "p", "s", "x", False, "f", "translated"), ("a", "de", 5, "1", "p", "s", "y", False, "f", "translated"), ("a", "de", 1, "2", "p", "s", "z", False, "f", "translated"))
    got = {r.id: (r.target, r.status) for r in C.merge_targets(new, old).collect()}
    assert got == {"1": ("y", "translated"), "2": ("z", "needs_review"), "9": ("", "new")}


def test_neighbours_skip_frozen(spark):
    df = seg(spark, *[("a", "de", i, str(i), "p", f"s{i}", "", i == 1, "f", "new") for i in range(4)])
    got = [(r.prev_source, r.next_source) for r in C.neighbours(df, ["doc_path", "lang"]).orderBy("ord").collect()]
    assert got == [("", "s2"), ("s0", "s2"), ("s0", "s3"), ("s2", "")]


def test_changed_inputs(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "path string, hash string")
    assert rows(C.changed_inputs(old, new)) == [("b", "2"), ("c", "1")]
    assert rows(C.changed_inputs(old, new, old, old)) == [("b", "2"), ("c", "1")]
    assert len(rows(C.changed_inputs(old, new, old, new))) == 3
    assert rows(C.changed_inputs(old, old)) == []


def test_sync_targets(spark, rows):
    to = seg(spark, ("a", "de", 0, "1", "p", "s", "", False, "f", "new"), ("b", "de", 0, "2", "p", "s", "", False, "f", "new"), ("a", "de", 1, "3", "p", "s", "", True, "f", "new"))
    frm = seg(spark, ("a", "de", 0, "x", "p", "s", "t0", False, "f", "translated"), ("a", "de", 3, "y", "p", "s", "t1", False, "f", "needs_review"), ("a", "de", 4, "z", "p", "s", "t2", False, "f", "new"))
    assert rows(C.sync_targets(to, frm)) == [("a", "1", "t1", "translated", "y")]


def plain_reuse(new, old, least):
    used, out = set(), []
    for s in new:
        best, top = None, 0
        for o in old:
            if o["kind"] == s["kind"] and o["id"] not in used:
                r = difflib.SequenceMatcher(None, s["t"], o["t"]).ratio()
                if r > top:
                    best, top = o, r
        if best is not None and top >= least:
            used.add(best["id"])
            out.append((s["ord"], best["id"], "current" if best["f"] == s["f"] else "needs_review"))
    return out


def test_reuse_ids_equals_the_plain_greedy_match(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "one", "two"]
    for trial in range(4):
        make = lambda tag: [{"kind": r.choice(["p", "h"]), "t": " ".join(r.choice(words) for _ in range(r.randrange(0, 9))), "id": f"{tag}{i}", "ord": i} for i in range(25)]
        new, old = make("n"), make("o")
        for x in new + old:
            x["f"] = x["t"]
        df = lambda side: spark.createDataFrame([("d", x["kind"], x["ord"], x["id"], x["f"], x["t"], "new") for x in side], "doc_path string, kind string, ord int, id string, fingerprint string, src_text string, status string")
        got = sorted((x.ord, x.id, x.status) for x in C.reuse_ids(df(new), df(old)).collect() if x.status != "new")
        assert got == sorted(plain_reuse(new, old, 0.88)), trial


def test_translate_native_and_by_provider(spark, rows):
    df = seg(spark, ("a", "de", 0, "1", "p", "one", "", False, "f", "new"), ("a", "de", 1, "2", "p", "two", "", False, "f", "new"), ("a", "de", 2, "3", "p", "x", "done", False, "f", "new"))
    assert rows(P.translate(df, "mock", ["doc_path"]).select("id", "target")) == [("1", "[de] one"), ("2", "[de] two")]

    def shout(items, lang):
        return [f"{lang}:{i['source'].upper()}:{i['next_source']}" for i in items]

    assert rows(P.translate(df, shout, ["doc_path"]).select("id", "target", "provider")) == [("1", "de:ONE:two", "shout"), ("2", "de:TWO:x", "shout")]
    assert P.payloads(df, ["doc_path"]).count() == 1


def test_hooks(spark):
    hooks = P.Hooks()
    hooks.register("post_compile", lambda df: df.withColumn("x", F.lit(1)))
    hooks.register("post_compile", lambda df: None)
    hooks.load(["no_such_module_anywhere"])
    assert hooks.apply("post_compile", spark.range(1)).columns == ["id", "x"] and hooks.failures[0][0] == "no_such_module_anywhere"
