import hashlib
import html
import random

from pyspark.sql import functions as F

from verbaloom.functions import jsonish, markup, similarity
from verbaloom.functions import text as T

ODD = ["", " ", "a", " ", " ", "\x1c", "\x85", "\t", "\n", "\r\n", "ß", "İ", "é", "😀", "“", "\\", '"', "\\n", "<", "&", "'", "Ä"]


def strings(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(8))) for _ in range(n)]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def test_normalised_and_hashes_equal_python(spark):
    values = strings(400, 1)
    got = frame(spark, values).select("i", T.normalised(F.col("s")).alias("n"), T.source_key(F.col("s")).alias("k")).orderBy("i").collect()
    for v, r in zip(values, got):
        want = " ".join(v.replace("\r\n", "\n").split())
        assert r.n == want and r.k == hashlib.sha256(want.encode()).hexdigest()


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "s string")
    r = df.select(T.normalised(F.col("s")).alias("n"), T.fingerprint(F.col("s")).alias("f"), T.slug(F.col("s")).alias("g"), T.po_escape(F.col("s")).alias("p"), F.size(markup.link_urls(F.col("s"))).alias("l")).first()
    assert r.n is None and r.f == "sha256:" + hashlib.sha256(b"").hexdigest() and r.g == "section" and r.p == "" and r.l == 0


def test_po_escape_round_trip(spark):
    values = strings(300, 2) + ['say "hi"', "a\\nb", "a\nb"]
    got = frame(spark, values).select("i", T.po_unescape(T.po_escape(F.col("s"))).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == values


def test_html_escape_equals_python(spark):
    values = strings(200, 3)
    assert [r.h for r in frame(spark, values).select("i", T.html_escape(F.col("s")).alias("h")).orderBy("i").collect()] == [html.escape(v) for v in values]


def test_slug(spark):
    values = {"Risks and Open Questions": "risks-and-open-questions", " A__b  c!": "a-b-c", "???": "section", "Über-Größe": "über-größe", "--x--": "x"}
    assert [r.g for r in frame(spark, list(values)).select("i", T.slug(F.col("s")).alias("g")).orderBy("i").collect()] == list(values.values())


def test_front_matter_title_and_paths(spark):
    text = "---\ntitle: 'Eins'\norder: 3\ntitle: \"Zwei\"\n---\n# Drei\n"
    df = spark.createDataFrame([(text, "docs/a/b.md"), ("x\n# Vier \n", "docs/c.mdx"), ("", "d.md")], "t string, p string")
    got = df.select(T.page_title(F.col("t"), F.col("p")).alias("t"), T.output_path(F.col("p"), "html", F.lit("en")).alias("e"), T.output_path(F.col("p"), "html", F.lit("de")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("Zwei", "a/b.en.html", "a/b.html"), ("Vier", "c.en.html", "c.html"), ("d", "d.en.html", "d.html")]


def test_markup(spark):
    s = "![i](p.png) [a](u)[b]( v ) `x` {{n}} {k} %s :id <b> <Tab a=\"1\">y</Tab> a:b"
    r = spark.createDataFrame([(s,)], "s string").select(*[f(F.col("s")).alias(n) for n, f in (("l", markup.link_urls), ("i", markup.image_urls), ("c", markup.code_spans), ("p", markup.placeholders), ("t", markup.tags))]).first()
    assert (r.l, r.i, r.c, r.t) == (["u", "v"], ["p.png"], ["x"], ['<Tab a="1">', "</Tab>"])
    assert r.p == sorted({"{{n}}", "{k}", "%s", ":id", "<b>", "</Tab>", ":b"})


def test_asset_refs(spark):
    s = "![](a/b.png) ![](http://x/y.png) ![](#z) ![](mailto:x) ![](  )"
    assert spark.createDataFrame([(s,)], "s string").select(markup.asset_refs(F.col("s"))).first()[0] == ["a/b.png"]


def test_hashed_vectors_and_cosine(spark):
    df = spark.createDataFrame([("Hello world",), ("hello  WORLD",), ("",), (None,)], "s string").withColumn("v", similarity.hashed_vectors("s"))
    v = [r.v for r in df.collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-5 and not any(v[2]) and not any(v[3])
    assert abs(df.limit(1).select(similarity.cosine(F.col("v"), F.col("v"))).first()[0] - 1) < 1e-5


def test_json_repair(spark):
    values = ['["a",]', '```json\n{"translations": ["a",],}\n```', 'Sure: {"x": 1,} ok', "no json", None, "", '{"a": [1, 2']
    got = [r.j for r in frame(spark, values).select("i", jsonish.parseable(F.col("s")).alias("j")).orderBy("i").collect()]
    assert got[:3] == ['["a"]', '{"translations": ["a"]}', '{"x": 1}'] and got[3:] == [None] * 4


def test_translation_shapes(spark):
    assert jsonish.coerce(["a", "b"], ["1", "2"]) == ["a", "b"]
    assert jsonish.coerce([{"id": "2", "text": "b"}, {"id": "1", "target": "a"}], ["1", "2"]) == ["a", "b"]
    assert jsonish.coerce({"results": [{"translation": "a"}]}, ["1"]) == ["a"]
    assert jsonish.coerce({"1": {"target": "a"}, "2": "b"}, ["1", "2"]) == ["a", "b"]
    assert jsonish.coerce(["a"], ["1", "2"]) is None
    df = spark.createDataFrame([("b", ["1", "2"], '["x"]'), ("c", ["3"], '["y",]'), ("d", None, None)], "batch string, ids array<string>, reply string")
    got = sorted(map(tuple, jsonish.translations(df, "batch", "ids", "reply").collect()))
    assert got == [("b", "1", None, False), ("b", "2", None, False), ("c", "3", "y", True)]
