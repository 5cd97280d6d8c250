"""Cases of the block grammar, written by hand from the CommonMark specification: text, then kind and text of each segment."""

import pytest

from verbaloom.operators.blocks import blocks

H, P, LI, BQ, TC, CB, HB = "heading", "paragraph", "list_item", "blockquote", "table_cell", "code_block", "html_block"
CASES = {
    "headings": [
        ("# a", [(H, "a")]), ("## a", [(H, "a")]), ("###### a", [(H, "a")]), ("####### a", [(P, "####### a")]), ("#a", [(P, "#a")]), ("#\ta", [(H, "a")]), ("# a #", [(H, "a")]), ("## a ####", [(H, "a")]), ("# a#", [(H, "a#")]),
        ("   # a", [(H, "a")]), ("    # a", []), ("a\n# b", [(P, "a"), (H, "b")]), ("# a\nb", [(H, "a"), (P, "b")]), ("#", [(H, "")]), ("#5 bolt", [(P, "#5 bolt")]), ("\\# a", [(P, "\\# a")]),
        ("a\n=", [(H, "a")]), ("a\n---", [(H, "a")]), ("a\nb\n===", [(H, "a\nb")]), ("a\n\n===", [(P, "a"), (P, "===")]), ("a\n= =", [(P, "a\n= =")]), ("---\na", [(P, "a")]), ("# a\n---", [(H, "a")]), ("> a\n---", [(BQ, "a")]), ("- a\n---", [(LI, "a")]),
    ],
    "breaks": [("***", []), ("---", []), ("___", []), (" * * *", []), ("- - -", []), ("--", [(P, "--")]), ("+++", [(P, "+++")]), ("a\n***\nb", [(P, "a"), (P, "b")]), ("_ _ _ a", [(P, "_ _ _ a")]), ("- a\n***\n- b", [(LI, "a"), (LI, "b")])],
    "paragraphs": [("a\nb", [(P, "a\nb")]), ("a\n\nb", [(P, "a"), (P, "b")]), ("  a\n b", [(P, "a\nb")]), ("a\n      b", [(P, "a\nb")]), ("\n\na\n\n", [(P, "a")]), ("[a]: /u", []), ("[a]: /u\n\n[a]", [(P, "[a]")]), ("a\n[b]: /u", [(P, "a\n[b]: /u")])],
    "indented code": [("    a", []), ("\ta", []), ("    a\n\n    b\nc", [(P, "c")]), ("a\n    b", [(P, "a\nb")]), ("# a\n    b\nc", [(H, "a"), (P, "c")])],
    "fences": [
        ("```\na\n```", [(CB, "a\n")]), ("~~~\na\n~~~", [(CB, "a\n")]), ("```\na\n~~~\n```", [(CB, "a\n~~~\n")]), ("````\na\n```\n````", [(CB, "a\n```\n")]), ("```\na", [(CB, "a\n")]), ("```\n```", [(CB, "")]), ("``\na\n``", [(P, "``\na\n``")]),
        (" ```\n a\n```", [(CB, "a\n")]), ("```\na\n  ```", [(CB, "a\n")]), ("```\na\n    ```", [(CB, "a\n    ```\n")]), ("a\n```\nb\n```\nc", [(P, "a"), (CB, "b\n"), (P, "c")]), ("``` a`b\nc", [(P, "``` a`b\nc")]), ("```py\n# a\n```", [(CB, "# a\n")]), ("~~~ a`b\nc\n~~~", [(CB, "c\n")]), ("```\n<div>\n```", [(CB, "<div>\n")]),
    ],
    "html": [
        ("<div>\na\n</div>\n\nb", [(HB, "<div>\na\n</div>\n"), (P, "b")]), ("<div>", [(HB, "<div>")]), ("<div>\n", [(HB, "<div>\n")]), ("<DIV CLASS=x>\na", [(HB, "<DIV CLASS=x>\na")]), ("</div>\n\na", [(HB, "</div>\n"), (P, "a")]),
        ("<script>\nlet a;\n\nb\n</script>\nc", [(HB, "<script>\nlet a;\n\nb\n</script>\n"), (P, "c")]), ("<pre>\n\na\n</pre>", [(HB, "<pre>\n\na\n</pre>")]), ("<style>\n\np{}\n", [(HB, "<style>\n\np{}\n")]), ("<textarea>\n\n# a\n\n</textarea>\nb", [(HB, "<textarea>\n\n# a\n\n</textarea>\n"), (P, "b")]),
        ("<!-- a\n\nb -->\nc", [(HB, "<!-- a\n\nb -->\n"), (P, "c")]), ("<!-- a --> b\nc", [(HB, "<!-- a --> b\n"), (P, "c")]), ("<?php\n\n?>\na", [(HB, "<?php\n\n?>\n"), (P, "a")]), ("<!DOCTYPE html>\na", [(HB, "<!DOCTYPE html>\n"), (P, "a")]), ("<![CDATA[\n\na]]>\nb", [(HB, "<![CDATA[\n\na]]>\n"), (P, "b")]),
        ("<my-tag a='b'>\nc", [(HB, "<my-tag a='b'>\nc")]), ("<my-tag>c", [(P, "<my-tag>c")]), ("a\n<my-tag>", [(P, "a\n<my-tag>")]), ("a\n<div>", [(P, "a"), (HB, "<div>")]), ("a\n<!-- b -->", [(P, "a"), (HB, "<!-- b -->")]), ("    <div>", []), ("  <div>\n*a*", [(HB, "  <div>\n*a*")]), ("<a.b>", [(P, "<a.b>")]), ("< div>", [(P, "< div>")]),
        ("<script>a</script> b\n\nc", [(HB, "<script>a</script> b\n"), (P, "c")]), ("- a\n<!-- b -->\nc", [(LI, "a"), (HB, "<!-- b -->\n"), (P, "c")]),
    ],
    "lists": [
        ("- a\n- b", [(LI, "a"), (LI, "b")]), ("* a", [(LI, "a")]), ("+ a", [(LI, "a")]), ("1. a\n2. b", [(LI, "a"), (LI, "b")]), ("1) a", [(LI, "a")]), ("-a", [(P, "-a")]), ("- a\n\n- b", [(LI, "a"), (LI, "b")]), ("- a\n\n  b", [(LI, "a\nb")]), ("- a\n\nb", [(LI, "a"), (P, "b")]), ("- a\nb", [(LI, "a\nb")]),
        ("- a\n  - b", [(LI, "a\nb")]), ("- a\n  - b\n  - c", [(LI, "a\nb"), (LI, "c")]), ("a\n- b", [(P, "a"), (LI, "b")]), ("a\n1. b", [(P, "a"), (LI, "b")]), ("a\n2. b", [(P, "a\n2. b")]), ("-", []), ("- a\n-\n- b", [(LI, "a"), (LI, "b")]), ("1234567890. a", [(P, "1234567890. a")]), ("- # a", [(LI, "a")]), ("- > a", [(LI, "a")]), ("- [ ] a", [(LI, "[ ] a")]), ("- a\n\n      b", [(LI, "a")]), ("- ```\n  a\n  ```\n- b", [(LI, "b")]),
    ],
    "quotes": [("> a", [(BQ, "a")]), (">a", [(BQ, "a")]), ("> a\n> b", [(BQ, "a\nb")]), ("> a\nb", [(BQ, "a\nb")]), ("> a\n\n> b", [(BQ, "a"), (BQ, "b")]), ("> # a\n> b", [(BQ, "a\nb")]), ("> > a", [(BQ, "a")]), ("> [!NOTE]\n> a", [(BQ, "a")]), ("> - a", [(BQ, "a")]), (">", []), ("> a\n# b", [(BQ, "a"), (H, "b")]), ("   > a", [(BQ, "a")]), ("    > a", [])],
    "tables": [
        ("|a|b|\n|-|-|\n|c|d|", [(TC, x) for x in "abcd"]), ("a|b\n-|-\nc|d", [(TC, x) for x in "abcd"]), ("|a|\n|:-:|", [(TC, "a")]), ("|a|b|\n|-|\n", [(P, "|a|b|\n|-|")]), ("|a|b|\n|-|-|\n|c|\n", [(TC, x) for x in "abc"]), ("|a|b|\n|-|-|\n|c|d|e|", [(TC, x) for x in "abcd"]),
        ("|a|b|\n|-|-|\n\nc", [(TC, "a"), (TC, "b"), (P, "c")]), ("|a|b|\n|-|-|\n> c", [(TC, "a"), (TC, "b"), (BQ, "c")]), ("|a\\|b|c|\n|-|-|", [(TC, "a|b"), (TC, "c")]), ("a\n|b|\n", [(P, "a\n|b|")]),
    ],
    "admonitions": [("::: tip\na\n:::", [("admonition_title", "Tip"), ("admonition_body", "a")]), ("::: tip T\na\n:::", [("admonition_title", "T"), ("admonition_body", "a")]), ("::: tip\na", [(P, "::: tip\na")]), (":::\na\n:::", [(P, ":::\na\n:::")])],
    "inside": [
        ("![a](b)", [(P, "![a](b)"), ("image_alt", "a")]), ("[a](b)", [(P, "[a](b)"), ("link_text", "a")]), ("![a](b) [c](d)", [(P, "![a](b) [c](d)"), ("image_alt", "a"), ("link_text", "c")]), ("- [a](b)", [(LI, "[a](b)")]), ("![](b)", [(P, "![](b)"), ("image_alt", "")]),
        ('x <Tab title="a">b</Tab>', [(P, 'x <Tab title="a">b</Tab>'), ("jsx_prop", "a"), ("jsx_child", "b")]), ('<div title="a">\n\n', [(HB, '<div title="a">\n'), ("jsx_prop", "a")]), ("x <A><b></b></A>", [(P, "x <A><b></b></A>")]),
    ],
    "front matter": [("---\na: b\n---\n# c", [(H, "c")]), ("---\na: b\n---", []), ("a\n---\nb\n---", [(H, "a"), (H, "b")]), ("---\r\na: b\r\n---\r\nc\r\nd", [(P, "c\nd")])],
}


@pytest.mark.parametrize(("text", "want"), [c for cases in CASES.values() for c in cases])
def test_case(text, want):
    assert [(b.kind, b.text) for b in blocks(text)] == want


def test_there_are_many():
    assert sum(map(len, CASES.values())) >= 130
