from pyspark.sql import functions as F

from verbaloom.operators import qa
from verbaloom.operators import terms as O

PAIR = "id string, doc_path string, kind string, source string, target string, frozen boolean, status string"


def broken(spark, source, target):
    df = spark.createDataFrame([("1", "d", "p", source, target, False, "x")], PAIR)
    return [r.rule for r in qa.lint(df, ["id"]).collect()]


def test_each_rule(spark):
    assert broken(spark, "[a](u)", "a") == ["L1"]
    assert broken(spark, "[a](u)", "[a](v)") == ["L2"]
    assert broken(spark, "![a](u)", "a") == ["L3"]
    assert broken(spark, "![a](u)", "![a](v)") == ["L4"]
    assert broken(spark, "`x`", "x") == ["L5"]
    assert broken(spark, "x" * 21, "y" * 32) == ["L6"] and broken(spark, "x" * 20, "y" * 99) == [] and broken(spark, "x" * 22, "y" * 33) == []
    assert broken(spark, "x" * 21, "y" * 9) == ["L7"] and broken(spark, "x" * 20, "y") == []
    assert broken(spark, "{{n}}", "n") == ["L8"] and broken(spark, "<Tab a b>", "<Tab a c>") == ["L9"]
    assert broken(spark, "abc", "") == [] and broken(spark, "abc", None) == [] and broken(spark, None, "abc") == []


def test_frozen_and_empty_are_not_checked(spark):
    df = spark.createDataFrame([("1", "d", "p", "`x`", "x", True, "x"), ("2", "d", "p", "`x`", "", False, "x"), ("3", "d", "p", "`x`", "y", None, "x")], PAIR)
    assert [r.id for r in qa.lint(df, ["id"]).collect()] == ["3"]
    assert qa.lint(df.limit(0), ["id"]).count() == 0


def test_repairs_and_their_idempotence(spark):
    cases = {
        "1": ("[a](u) `c` {{n}} <Tab>x</Tab>", "text", "text [a](u) `c` <Tab> {{n}} </Tab>"),
        "2": ("[a](u) [b](v)", "[x](1) and [y](2)", "[x](u) and [y](v)"),
        "3": ("![i](p.png)", "bild", "bild\n\n![i](p.png)"),
    }
    df = spark.createDataFrame([(k, "d", "p", s, t, False, "x") for k, (s, t, _) in cases.items()] + [("9", "d", "p", "plain", "schlicht", False, "x")], PAIR)
    got = {r.id: (r.fixed, r.status) for r in qa.repaired(df).collect()}
    assert set(got) == set(cases) and got["2"] == (cases["2"][2], "needs_review") and got["3"][0] == cases["3"][2]
    for part in ("[a](u)", "`c`", "{{n}}", "<Tab>", "</Tab>"):
        assert part in got["1"][0]
    again = spark.createDataFrame([(k, "d", "p", cases[k][0], v[0], False, "x") for k, v in got.items()], PAIR)
    assert qa.repaired(again).count() == 0


def test_tone_products_and_visual(spark, rows):
    df = spark.createDataFrame([("1", "d", "p", "MyTool and PowerShell", "Hast du powershell?", False, "x"), ("2", "d", "p", "x", "Haben Sie", False, "x")], PAIR)
    assert rows(qa.tone(df, ["id"], "formal")) == [("1", "du")] and qa.tone(df, ["id"], "locker").count() == 0
    assert rows(qa.lost_products(df, ["id"])) == [("1", "MyTool"), ("1", "PowerShell")]
    page = spark.createDataFrame([('<td data-token="a">' + "x" * 81 + '</td><p data-token="b"><b>' + "y" * 240 + '</b></p><h2 data-token="c">' + "z " * 61 + "</h2>",)], "html string")
    assert rows(qa.visual(qa.token_blocks(page, "html")).drop("shown")) == [("a", "td", 81, 80), ("c", "h2", 121, 120)]


def test_messages_and_repairs_say_what_they_did(spark):
    pair = ("1", "d", "p", "See [a](u) `c` {x} {{it's}} <T> <T>", "Siehe", False, "x")
    df = spark.createDataFrame([pair], PAIR).withColumn("meta", F.lit('{"level": 1}'))
    said = {r.rule: r.message for r in qa.issues(df, ["id"]).collect()}
    assert said["L1"] == "Markdown link count changed: source=1 target=0" and said["L5"] == "Inline code span count changed: source=1 target=0" and said["L9"] == "JSX/MDX tag mismatch: source=['<T>', '<T>'] target=[]"
    assert said["L8"] == """Placeholder mismatch: source=['<T>', '{x}', "{{it's}}"] target=[]"""
    line = qa.issues(df, ["id"]).filter("rule = 'L1'").select(qa.format_issue(*[F.col(c) for c in ("level", "id", "kind", "message", "source", "target")])).first()[0]
    assert line.split("\n") == ["[WARN] token=1 kind=p", "       Markdown link count changed: source=1 target=0", "       Source: " + pair[3], "       Target: Siehe"]
    fix = qa.repaired(df).first()
    assert fix.fixed == "Siehe [a](u) `c` <T> {x} {{it's}}" and fix.status == "needs_review"
    assert fix.notes == ["reinserted missing markdown links", "reinserted inline code `c`", "reinserted placeholder <T>", "reinserted placeholder {x}", "reinserted placeholder {{it's}}"]
    assert fix.meta.startswith('{"level": 1, "auto_fixed":true,"auto_fix_notes":["reinserted missing')
    assert qa.repaired(df.withColumn("target", F.col("source"))).count() == 0 and qa.repaired(df.limit(0)).count() == 0


def test_model_results_are_joined_by_id(spark, rows):
    df = spark.createDataFrame([("1", "d", "p", "s", "t", False, "x"), ("2", "d", "p", "s", "", False, "x"), ("3", "d", "p", "s", "t", True, "x")], PAIR).withColumn("ord", F.lit(0))
    reply = '```json\n[{"id": "1", "message": "m"}, {"id": "1", "level": "error", "rule_violated": "r"}, {"id": "1"}, {"id": "2", "message": "no target"}, {"id": "3"}, {"id": "9"},]\n```'
    got = qa.model_issues(df, spark.createDataFrame([(reply,), ("prose",), (None,)], "reply string"), "reply")
    assert rows(got.select("id", "level", "message")) == [("1", "ai-warn", "AI semantic warning"), ("1", "ai-warn", "m"), ("1", "error", "r")]


def test_terms(spark, rows):
    df = spark.createDataFrame([("Élan Café Résumé und MyTool API mit snake_case Wissenschaften", ), (None,), ("",)], "t string")
    got = dict(rows(O.term_scores(df, "t")))
    assert got["Café Résumé"] == 3 or "Café Résumé" in got
    assert got["MyTool"] == 3 and got["API"] == 5 and got["snake_case"] == 2 and got["Wissenschaften"] == 2 and "und" not in got
    glossary = spark.createDataFrame([("mytool", "x", None), (None, None, None)], "source string, target string, note string")
    fresh = {r.source for r in O.new_terms(spark.createDataFrame([("MyTool", 3), ("Api", 2), ("API", 5)], "term string, score long"), glossary).collect()}
    assert fresh == {"API"}


def test_relevant_terms(spark, rows):
    g = spark.createDataFrame([("C++", "c", ""), ("Open file", "Datei", "n"), ("file", "f", None), ("file", "f", None), ("", "x", "")], "source string, target string, note string")
    t = spark.createDataFrame([(1, "Please OPEN file."), (2, "profile only"), (3, None), (4, "I like C++ a lot")], "id int, text string")
    assert rows(O.relevant_terms(t, "id", "text", g).select("id", "source")) == [(1, "Open file"), (1, "file"), (4, "C++")]
    prompt = O.glossary_prompt(O.relevant_terms(t, "id", "text", g), "id").filter("id = 1").first().prompt
    assert prompt == "Glossary entries that must be respected:\n- Open file -> Datei (n)\n- file -> f"
    assert O.relevant_terms(t, "id", "text", g.limit(0)).count() == 0 and F is not None
