from pyspark.sql import functions as F

from verbaloom.operators import compose as O
from verbaloom.operators import exchange as X
from verbaloom.operators import segment as S
from verbaloom.operators import site

NOTES = """# Brainstorming

- Werkzeug soll Notizen aufnehmen
- Zielgruppe: Entwickler
- Pipeline: Notizen -> Graph
- Risiko: keine Fakten erfinden
- Wie markieren wir das?
- plain text here
```
- not an item
```
one line
goes on

Note: a statement
"""


def made(spark, text=NOTES):
    df = spark.createDataFrame([(1, text)], "doc int, text string")
    return df, O.items(df, "doc", "text")


def test_items(spark):
    _, found = made(spark)
    got = [(r.item_index, r.kind, r.text) for r in found.orderBy("item_index").collect()]
    assert got[0] == (1, "heading", "Brainstorming") and got[-2:] == [(8, "paragraph", "one line goes on"), (9, "statement", "Note: a statement")]
    assert len(got) == 9 and not any("not an item" in t for *_, t in got)


def test_routing_and_modules(spark):
    df, found = made(spark)
    routed = O.routed(found)
    by = {r.item_index: r.module for r in routed.collect()}
    assert by[1] == "Concepts" and by[3] == "Overview" and by[4] in ("Concepts", "Architecture") and by[5] == "Risks and Open Questions" and by[6] == "Risks and Open Questions"
    modules = {r.title: r for r in O.modules(routed).collect()}
    assert modules["Risks and Open Questions"].risks == ["Risiko: keine Fakten erfinden"] and modules["Risks and Open Questions"].open_questions == ["Wie markieren wir das?"]
    assert modules["Overview"].evidence[0].startswith("Note #2: ")
    docs = {r.path: r.text for r in O.module_documents(O.modules(routed)).collect()}
    assert docs["overview.md"].startswith('---\ntitle: "Overview"\n') and "## Key Points" in docs["overview.md"] and docs["overview.md"].endswith("\n")
    index = O.index_documents(O.modules(routed), O.titles(df, found, "doc", "text"), O.global_questions(found)).first()
    assert "# Brainstorming" in index.text and "- [Overview](./overview.md)" in index.text and "- Wie markieren wir das?" in index.text
    lines = [r.line for r in O.open_questions(O.modules(routed), O.global_questions(found)).orderBy("place").collect()]
    assert lines == ["- Wie markieren wir das?"]


def test_overview_cap_equals_running_state(spark):
    text = "\n".join(f"- neutral {i}" for i in range(9))
    _, found = made(spark, text)
    got = [r.module for r in O.routed(found).orderBy("item_index").collect()]
    assert got == ["Overview"] * 6 + ["Implementation"] * 3


def test_notes_without_content(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "```\nx\n```")], "doc int, text string")
    assert O.items(df, "doc", "text").count() == 0
    titles = O.titles(df, O.items(df, "doc", "text"), "doc", "text")
    assert {r.title for r in titles.collect()} == {O.DEFAULT_TITLE}


def test_model_graph(spark):
    df = spark.createDataFrame([(1, '{"modules": [{"title": "T t", "claims": ["a", " ", "b"], "source_items": [1, "x", "2"]}, {"purpose": ""}]}'), (2, "broken"), (3, None)], "doc int, reply string")
    got = O.normalised_graph(df, "doc", "reply").orderBy("module").collect()
    assert [(r.doc, r.title, r.slug, r.claims, r.source_items) for r in got] == [(1, "T t", "t-t", ["a", "b"], [1, 2]), (1, "Section 2", "section-2", [], [])]


CAT = "doc_path string, lang string, ord int, id string, kind string, source string, target string, frozen boolean, fingerprint string, status string, meta string"
KEYS = ["doc_path", "lang"]


def cat(spark, *rows):
    return spark.createDataFrame([("d.md", "en", i, f"i{i}", k, s, t, fz, "f", st, m) for i, (k, s, t, fz, st, m) in enumerate(rows)], CAT)


def test_po_round_trip_and_merge(spark):
    odd = ['say "hi"', "back\\slash", "a\\nb", "line\nbreak", ""]
    df = cat(spark, *[("paragraph", s, s, False, "translated", "{}") for s in odd], ("code_block", "x", "y", True, "", "{}"))
    back = {r.id: r.target for r in X.po_entries(X.po_documents(df, KEYS), KEYS, "text").collect()}
    assert back == {f"i{i}": s for i, s in enumerate(odd)}
    merged = {r.id: (r.target, r.status) for r in X.po_merged(df.withColumn("target", F.lit("old")), X.po_entries(X.po_documents(df, KEYS), KEYS, "text"), KEYS).collect()}
    assert merged["i0"] == (odd[0], "translated") and merged["i4"] == ("old", "translated") and merged["i5"] == ("old", "")


def test_xliff(spark):
    df = cat(spark, ("paragraph", "a < `b` {{c}} <Tab>d</Tab>", "é", False, "new", "{}"))
    text = X.xliff_documents(df, KEYS).first().text
    assert '<source>a &lt; <ph id="1" equiv="`b`"/> <ph id="2" equiv="{{c}}"/> <ph id="3" equiv="&lt;Tab&gt;"/>d<ph id="4" equiv="&lt;/Tab&gt;"/></source><target>é</target>' in text


def test_markdown_and_html(spark):
    df = cat(
        spark, ("heading", "T", "", False, "new", '{"level": 2}'), ("list_item", "a\nb", "", False, "new", None), ("list_item", "c", "C", False, "new", "{}"), *[("table_cell", x, "", False, "new", "{}") for x in "pqrst"],
        ("code_block", "x\n", "", True, "", '{"lang": "py"}'), ("admonition_title", "N", "", False, "new", '{"admonition_type": "tip"}'), ("admonition_body", "B", "", False, "new", "{}"), ("link_text", "no", "", False, "new", "{}"), ("blockquote", "q\nr", "", False, "new", "{}"),
    )
    text = X.markdown_documents(X.shown(df), KEYS).first().text
    assert text == "## T\n\n- a\n  b\n- C\n\n| p | q |\n| --- | --- |\n| r | s |\n| t |\n\n```py\nx\n```\n\n::: tip N\nB\n:::\n\n> q\n> r\n"
    page = X.html_documents(X.shown(df), KEYS).first().html
    assert page.startswith('<h2 id="i0" data-token="i0">T</h2>\n<ul>\n<li data-token="i1">a\nb</li>\n<li data-token="i2">C</li>\n</ul>\n<table><tbody>')
    assert page.count("<tr>") == page.count("</tr>") == 3 and '<pre data-token="i8"><code class="language-py">x\n</code></pre>' in page and page.endswith("</blockquote>")


INLINE = {
    "a **b** *c* ***d*** __e__ _f_": "a <strong>b</strong> <em>c</em> <em><strong>d</strong></em> <strong>e</strong> <em>f</em>", "a_b_c a*b*c": "a_b_c a<em>b</em>c", "2*3*4 5 * 6": "2<em>3</em>4 5 * 6", "**a*": "*<em>a</em>", "*a **b** c*": "<em>a <strong>b</strong> c</em>",
    "***a** b*": "<em><strong>a</strong> b</em>", "`**x**` ``a`b``": "<code>**x**</code> <code>a`b</code>", "`a": "`a", "[a](/_x_/y)": '<a href="/_x_/y">a</a>', '[a *b*](u "t")': '<a href="u" title="t">a <em>b</em></a>', "![a *b*](u)": '<img src="u" alt="a b" />', "[x](<a b>)": '<a href="a%20b">x</a>',
    "**[a](b)**": '<strong><a href="b">a</a></strong>', "[a]": "[a]", "[a][b]": "[a][b]", "[ü](/ä?x=1&y=2)": '<a href="/%C3%A4?x=1&amp;y=2">ü</a>', "<b>x</b> & &amp; \"q\" 's": "<b>x</b> &amp; &amp; &quot;q&quot; 's", "a < b > c": "a &lt; b &gt; c", "\\*a\\* \\<b>": "*a* &lt;b&gt;",
    "x  \ny\\\nz\nw": "x<br />\ny<br />\nz\nw", "<http://a.b>": '<a href="http://a.b">http://a.b</a>', "<!-- *a* --> *b*": "<!-- *a* --> <em>b</em>", "`d<`": "<code>d&lt;</code>", "(*a*), \"**b**\"": "(<em>a</em>), &quot;<strong>b</strong>&quot;", "* a *": "* a *", "_a*b_": "<em>a*b</em>", "": "",
}


def test_inline(spark):
    assert {k: X.inline_html(k) for k in INLINE} == INLINE
    df = spark.createDataFrame([(k,) for k in INLINE] + [(None,)], "s string")
    assert [r[0] for r in df.coalesce(1).select(X.inline("s")).collect()] == [*INLINE.values(), ""]


def test_catalogues_and_manifests_are_read_back_whole(spark, tmp_path, rows):
    from verbaloom.sources import files, sinks

    df = cat(spark, ("heading", 'T "q" \\ /', "Ü\n2", False, "translated", '{"level": 2, "x": {"y": [1]}}'), ("code_block", "g", None, True, None, None), ("paragraph", None, "", False, "new", "not json"))
    full = X.catalogue_json(df, KEYS, include_frozen=True)
    sinks.write_texts(full.withColumn("p", F.lit("a/one.json")), "p", "json", str(tmp_path / "c")).collect()
    got = {r.id: r for r in files.catalogues(spark, str(tmp_path / "c")).collect()}
    assert (got["i0"].source, got["i0"].target, got["i0"].frozen, got["i0"].meta["level"]) == ('T "q" \\ /', "Ü\n2", False, "2")
    assert (got["i1"].frozen, got["i1"].status, got["i1"].target, got["i1"].meta) == (True, "", "", {}) and (got["i2"].source, got["i2"].meta) == ("", {})
    assert '"id":"i1"' not in X.catalogue_json(df, KEYS).first().json and X.catalogue_json(df.limit(0), KEYS).count() == 0
    sinks.write_texts(X.manifest_json(df, KEYS).withColumn("p", F.lit("m.json")), "p", "json", str(tmp_path / "m")).collect()
    assert [(r.ord, r.id, r.kind) for r in files.manifests(spark, str(tmp_path / "m")).orderBy("ord").collect()] == [(0, "i0", "heading"), (1, "i1", "code_block"), (2, "i2", "paragraph")]


def test_front_matter_survives(spark):
    import json

    from verbaloom.functions import text as T
    from verbaloom.operators.segment import segments

    docs = spark.createDataFrame([("a.md", "---\r\ntitle: A\r\n---\r\n# H\r\n\r\nx\r\n"), ("b.md", "# B")], "doc_path string, text string")
    fronts = docs.select("doc_path", T.front_block(F.col("text")).alias("front"))
    segs = segments(docs, "doc_path", "text").withColumns({"meta": F.to_json("meta"), "shown": F.col("src_text")})
    got = {r.doc_path: r.text for r in X.markdown_documents(segs, ["doc_path"], fronts=fronts).collect()}
    assert got == {"a.md": "---\ntitle: A\n---\n\n# H\n\nx\n", "b.md": "# B\n"}
    ir = json.loads({r.doc_path: r.json for r in X.document_json(segs, ["doc_path"], fronts).collect()}["a.md"])
    assert (ir["type"], ir["source"], ir["frontmatter"]) == ("document", "a.md", "---\ntitle: A\n---\n") and [(n["kind"], n["frozen"], n["meta"]) for n in ir["nodes"]] == [("heading", False, {"level": "1"}), ("paragraph", False, {})]


def test_whole_pages(spark):
    pages = spark.createDataFrame([("b", "/b.html", "B & C", 2), ("a", "a.html", None, None), ("c", "c.html", "C", 1)], "source string, url string, title string, page_order int")
    nav = X.navigation(pages).first().nav
    assert nav == '<a class="nav-link" href="/c.html">C</a>\n<a class="nav-link" href="/b.html">B &amp; C</a>\n<a class="nav-link" href="/a.html">a.html</a>'
    df = spark.createDataFrame([("a", "<p>x</p>", None), ("b", None, "<li>y</li>")], "doc_path string, html string, toc string")
    got = {r.doc_path: r.html for r in X.page_html(df, ["doc_path"], F.lit(nav), F.col("toc"), css="p{}", inspect=True).collect()}
    assert "<p>x</p></main>\n" in got["a"] and "On this page" not in got["a"] and "<ul><li>y</li></ul>" in got["b"] and '<body class="inspect">' in got["b"] and "<style>p{}</style>" in got["a"]


def test_token_listing_and_toc_and_diagrams(spark):
    df = cat(spark, ("heading", "T", "Ü", False, "translated", "{}"), ("code_block", "g\nh", "", True, "new", '{"lang": "mermaid"}'))
    assert X.token_listing(df, KEYS).first().text == "i0(heading translated): T\ni1(code_block frozen): g\\nh"
    assert X.contents(df, KEYS).first().toc == '<li><a href="#i0">Ü</a></li>'
    assert {r.id: r.kind for r in X.diagrams(df).collect()} == {"i0": "heading", "i1": "html_block"}


def test_segments_round_trip_through_markdown(spark):
    text = "# A\n\nBody text.\n\n- one\n- two\n\n> quote\n\n| a | b |\n| --- | --- |\n| c | d |\n"
    df = spark.createDataFrame([("d.md", text)], "path string, text string")
    segs = S.segments(df, "path", "text").withColumns({"shown": F.col("src_text"), "meta": F.to_json("meta"), "lang": F.lit("de")})
    assert X.markdown_documents(segs, KEYS).first().text == text


def test_site(spark):
    df = spark.createDataFrame([("docs/b.md", "---\norder: 2\n---\n# Zwei\nKatalog ```x```"), ("docs/a.md", None)], "path string, text string")
    pages = site.index(df, "path", "text")
    got = {r.source: (r.title, r.url, r.page_order) for r in pages.collect()}
    assert got == {"docs/b.md": ("Zwei", "b.html", 2), "docs/a.md": ("a", "a.html", 999)}
    assert [r.source for r in site.search(pages, "katalog").collect()] == ["docs/b.md"]
