"""Catalogues and segments in other forms: token lists, PO, XLIFF, Markdown, HTML, JSON, and PO back again."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verbaloom.functions import jsonish as J
from verbaloom.functions import text as T
from verbaloom.operators.catalogue import resolved

#: What an XLIFF placeholder stands for, and which helper segments a page leaves out.
PROTECTED = re.compile(r"(`[^`]+`|\{\{[^}]+\}\}|</?[A-Z][A-Za-z0-9_.]*\b[^>]*>)")
HELPERS = ("image_alt", "link_text", "jsx_prop", "jsx_child")


def ordered(value: Column, separator: str, by: str = "ord") -> Column:
    """All values of a group in order. A document is the unit of output, so its text is one value."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, value.alias("v")))), lambda x: x["v"]), separator)


def token_line(ident: Column, kind: Column, frozen: Column, status: Column, source: Column) -> Column:
    said = F.when(T.text_or_empty(status).isin("new", "current", ""), "").otherwise(F.concat(F.lit(" "), status))
    flag = F.concat(F.when(F.coalesce(frozen, F.lit(False)), " frozen").otherwise(""), said)
    return F.concat(ident, F.lit("("), kind, flag, F.lit("): "), F.replace(T.text_or_empty(source), F.lit("\n"), F.lit("\\n")))


def token_listing(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    line = token_line(*[F.col(c) for c in ("id", "kind", "frozen", "status", "source")])
    return catalogue.groupBy(*keys).agg(ordered(line, "\n").alias("text"))


def _object(c: Column) -> Column:
    """A JSON object as it stands; anything else as an empty one."""
    return F.when(T.text_or_empty(c).rlike(r"(?s)^\s*\{.*\}\s*$") & J.valid(c), F.trim(c)).otherwise("{}")


def _member(row: Column, name: str, value: Column) -> Column:
    """A row as a JSON object with one more member, which is JSON already."""
    return F.concat(F.regexp_replace(F.to_json(row, {"ignoreNullFields": "false"}), r"\}\z", ""), F.lit(f',"{name}":'), value, F.lit("}"))


def _texts(*columns: str) -> list[Column]:
    return [T.text_or_empty(F.col(c)).alias(c) for c in columns]


def catalogue_json(catalogue: DataFrame, keys: list[str], include_frozen: bool = False) -> DataFrame:
    """(keys, json): one catalogue document, in order; frozen segments are left out unless asked for.

    Null texts are written as empty, a null ``frozen`` as false, ``meta`` (JSON text) as an object. sources.files.catalogues reads it.
    """
    rows = catalogue if include_frozen else catalogue.filter(~F.coalesce("frozen", F.lit(False)))
    entry = _member(F.struct(*_texts("id", "kind", "source", "target"), F.coalesce("frozen", F.lit(False)).alias("frozen"), *_texts("fingerprint", "status")), "meta", _object(F.col("meta")))
    made = rows.groupBy(*keys).agg(ordered(entry, ",").alias("entries"))
    return made.select(*keys, F.concat(F.regexp_replace(F.to_json(F.struct(F.col("doc_path").alias("source"))), r"\}\z", ""), F.lit(',"entries":['), F.col("entries"), F.lit("]}")).alias("json"))


def manifest_json(segs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): the manifest of all segments, frozen ones too, in order; sources.files.manifests reads it."""
    node = F.struct("ord", F.struct(*_texts("id", "kind", "source", "fingerprint")).alias("n"))
    made = segs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["n"]).alias("nodes"))
    return made.select(*keys, F.to_json(F.struct(F.col("doc_path").alias("source"), "nodes")).alias("json"))


def document_json(segs: DataFrame, keys: list[str], fronts: DataFrame | None = None) -> DataFrame:
    """(keys, json): type, source, front matter and nodes of each document. fronts: doc_path and ``front``; without it, it is empty."""
    node = _member(F.struct(*_texts("id", "kind"), F.coalesce("frozen", F.lit(False)).alias("frozen")), "meta", _object(F.col("meta")))
    made = segs.groupBy(*keys).agg(ordered(node, ",").alias("nodes"))
    made = made.withColumn("front", F.lit("")) if fronts is None else made.join(fronts.select("doc_path", "front"), "doc_path", "left")
    head = F.to_json(F.struct(F.lit("document").alias("type"), F.col("doc_path").alias("source"), T.text_or_empty(F.col("front")).alias("frontmatter")))
    return made.select(*keys, F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"nodes":['), F.col("nodes"), F.lit("]}")).alias("json"))


PO_HEAD = 'msgid ""\nmsgstr ""\n"Content-Type: text/plain; charset=UTF-8\\n"\n\n'


def po_unit() -> Column:
    q = lambda k, c: F.concat(F.lit(f'{k} "'), T.po_escape(F.col(c)), F.lit('"'))
    note = F.concat(F.lit("#. kind="), T.text_or_empty(F.col("kind")), F.lit(" status="), T.text_or_empty(F.col("status")))
    return F.concat_ws("\n", F.concat(F.lit("#: "), F.col("doc_path")), note, q("msgctxt", "id"), q("msgid", "source"), q("msgstr", "target"))


def po_documents(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): gettext files; frozen segments are left out."""
    open_ = catalogue.filter(~F.coalesce("frozen", F.lit(False)))
    return open_.groupBy(*keys).agg(F.concat(F.lit(PO_HEAD), ordered(po_unit(), "\n\n"), F.lit("\n")).alias("text"))


def po_entries(documents: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, id, target): the entries of gettext files, each with the context that precedes it."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = documents.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    value = lambda k: T.po_unescape(F.regexp_extract("line", rf'^{k} "(.*)"$', 1))
    marked = rows.filter(F.col("line").rlike(r'^msg(ctxt|str) "')).withColumn("context", F.when(F.startswith("line", F.lit("msgctxt ")), value("msgctxt")))
    marked = marked.withColumn("id", F.lag("context").over(w))
    return marked.filter(F.startswith("line", F.lit("msgstr ")) & F.col("id").isNotNull()).select(*keys, "id", value("msgstr").alias("target"))


def po_merged(catalogue: DataFrame, entries: DataFrame, keys: list[str], blank_too: bool = False) -> DataFrame:
    """catalogue with the entries' targets, then translated; empty ones are ignored unless ``blank_too``."""
    new = entries.groupBy(*keys, "id").agg(F.max("target").alias("new"))
    joined = catalogue.join(new, [*keys, "id"], "left")
    takes = F.col("new").isNotNull() if blank_too else (T.text_or_empty(F.col("new")) != "")
    target = F.when(takes, F.col("new")).otherwise(F.col("target"))
    status = F.when(T.text_or_empty(F.col("new")) != "", F.lit("translated")).otherwise(F.col("status"))
    return joined.select(*[target.alias(c) if c == "target" else status.alias(c) if c == "status" else F.col(c) for c in catalogue.columns])


@F.pandas_udf(StringType())
def xliff_text(text: pd.Series) -> pd.Series:
    """Escaped text in which code, placeholders and tags are numbered elements."""

    def one(s: str) -> str:
        # The pattern is one group, so every second part is protected.
        parts = PROTECTED.split(s)
        held = [f'<ph id="{n}" equiv="{html.escape(x)}"/>' for n, x in enumerate(parts[1::2], 1)]
        return "".join(html.escape(plain) + ph for plain, ph in zip(parts[::2], [*held, ""], strict=True))

    return text.fillna("").map(one)


def xliff_documents(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): XLIFF 2.0 files; frozen segments are left out."""
    open_ = catalogue.filter(~F.coalesce("frozen", F.lit(False))).withColumns({"s": xliff_text("source"), "t": xliff_text("target")})
    unit = F.concat(F.lit('<unit id="'), T.html_escape(F.col("id")), F.lit('"><segment><source>'), F.col("s"), F.lit("</source><target>"), F.col("t"), F.lit("</target></segment></unit>"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="2.0" xmlns="urn:oasis:names:tc:xliff:document:2.0"><file id="'), T.html_escape(F.col("doc_path")), F.lit('">\n'))
    made = open_.groupBy(*keys).agg(ordered(unit, "\n").alias("units"))
    return made.select(*keys, F.concat(head, F.col("units"), F.lit("\n</file></xliff>\n")).alias("text"))


def _runs(segs: DataFrame, keys: list[str], rendered: list[str]) -> DataFrame:
    """run: number of the stretch of segments of one kind; place: number within it."""
    w = Window.partitionBy(*keys).orderBy("ord")
    start = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)), 0).otherwise(1)
    numbered = segs.filter(~F.col("kind").isin(*rendered)).withColumn("start", start).withColumn("run", F.sum("start").over(w))
    inner = Window.partitionBy(*keys, "run").orderBy("ord")
    return numbered.withColumn("place", F.row_number().over(inner) - 1)


def meta(key: str, default: str) -> Column:
    return F.coalesce(F.get_json_object("meta", f"$.{key}"), F.lit(default))


def markdown_documents(segs: DataFrame, keys: list[str], columns: int = 2, fronts: DataFrame | None = None) -> DataFrame:
    """(keys, text): documents written from segments, which bring ``meta`` as JSON and ``shown``, their text.

    fronts: doc_path and ``front``, the front matter with its rules, which goes before the text where there is one.
    """
    t = F.col("shown")
    runs = _runs(segs, keys, HELPERS)
    last = F.lead("run").over(Window.partitionBy(*keys).orderBy("ord")).eqNullSafe(F.col("run")) == F.lit(False)
    level = F.coalesce(F.try_to_number(meta("level", "1"), F.lit("9")).cast("int"), F.lit(1))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), columns), " | "), F.lit(" |"))
    place, width = F.col("place"), F.lit(columns)
    cell = F.concat(
        F.when(place % width == 0, "| ").otherwise(""), t,
        F.when((place % width == width - 1) | last, " |").otherwise(" | "),
        F.when((place == width - 1) | (last & (place < width)), F.concat(F.lit("\n"), rule)).otherwise(""),
        F.when(((place % width == width - 1) | last), "\n").otherwise(""), F.when(last, "\n").otherwise(""),
    )
    piece = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t, F.lit("\n\n")))
        .when(F.col("kind") == "list_item", F.concat(F.lit("- "), F.replace(t, F.lit("\n"), F.lit("\n  ")), F.lit("\n"), F.when(last, "\n").otherwise("")))
        .when(F.col("kind") == "blockquote", F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> ")), F.lit("\n\n")))
        .when(F.col("kind") == "code_block", F.concat(F.lit("```"), meta("lang", ""), F.lit("\n"), F.regexp_replace(t, r"\n+\z", ""), F.lit("\n```\n\n")))
        .when(F.col("kind") == "admonition_title", F.concat(F.lit("::: "), meta("admonition_type", "note"), F.lit(" "), t, F.lit("\n")))
        .when(F.col("kind") == "admonition_body", F.concat(t, F.lit("\n:::\n\n")))
        .when(F.col("kind") == "table_cell", cell)
        .otherwise(F.concat(t, F.lit("\n\n")))
    )
    whole = runs.withColumn("piece", piece).groupBy(*keys).agg(ordered(F.col("piece"), "").alias("text"))
    text = F.concat(F.regexp_replace("text", r"\s+\z", ""), F.lit("\n"))
    if fronts is None:
        return whole.select(*keys, text.alias("text"))
    front = F.regexp_replace(T.text_or_empty(F.col("front")), r"\s+\z", "")
    joined = whole.join(fronts.select("doc_path", "front"), "doc_path", "left")
    return joined.select(*keys, F.concat(F.when(front == "", "").otherwise(F.concat(front, F.lit("\n\n"))), text).alias("text"))


#: What stands in a line besides plain text: an escaped sign, code, an image or link, an address or tag of HTML.
PIECE = re.compile(
    r"\\([!-/:-@\[-`{-~])|(?<!`)(`+)(?!`)(.+?)(?<!`)\2(?!`)|(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*(<[^<>\n]*>|[^\s()<]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)"
    r"|<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|(<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*|!--.*?--|\?.*?\?|![A-Z][^>]*)>)|( {2,}|\\)?\n *",
    re.S,
)
RUN = re.compile(r"\*+|_+")


def _safe(s: str) -> str:
    """Escaped; entities of HTML are taken for their signs first."""
    return html.escape(html.unescape(s)).replace("&#x27;", "'")


def _address(s: str) -> str:
    s = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s[1:-1] if s.startswith("<") else s)
    return html.escape(quote(html.unescape(s), safe="!#$%&'()*+,-./:;=?@_~")).replace("&#x27;", "'")


def _emphasis(pieces: list[str], runs: list[tuple[int, str, int, bool, bool]]) -> None:
    """Turn runs of signs into tags, in place. runs: place, sign, length, may open, may close, in order.

    A closing run takes the nearest run before it that opens with its sign; what stands between loses its signs' meaning.
    A run that may do both pairs only if the lengths don't add up to a multiple of three, or both are one.
    """
    left = [size for _, _, size, _, _ in runs]
    opened, closed = [""] * len(runs), [""] * len(runs)
    waiting: list[int] = []
    for k, (_, sign, size, may_open, may_close) in enumerate(runs):
        while left[k] and may_close:
            fits = lambda j, sign=sign, size=size, both=may_open: runs[j][1] == sign and not ((both or runs[j][4]) and (runs[j][2] + size) % 3 == 0 and (runs[j][2] % 3 or size % 3))
            at = next((n for n in range(len(waiting) - 1, -1, -1) if fits(waiting[n])), None)
            if at is None:
                break
            j = waiting[at]
            del waiting[at + 1 :]
            n = 2 if left[k] > 1 and left[j] > 1 else 1
            tag = ("em", "strong")[n - 1]
            opened[j], closed[k] = f"<{tag}>" + opened[j], closed[k] + f"</{tag}>"
            left[j] -= n
            left[k] -= n
            if not left[j]:
                waiting.pop()
        if left[k] and may_open:
            waiting.append(k)
    for k, (at, sign, *_) in enumerate(runs):
        pieces[at] = closed[k] + sign * left[k] + opened[k]


def inline_html(s: str, plain: bool = False) -> str:
    """The inline Markdown of a text as HTML; plain: without tags, for what an image is called."""
    pieces: list[str] = []
    runs: list[tuple[int, str, int, bool, bool]] = []

    def put_text(lo: int, hi: int) -> None:
        last = lo
        for m in RUN.finditer(s, lo, hi):
            if m.start() > last:
                pieces.append(_safe(s[last : m.start()]))
            prev, nxt = (s[m.start() - 1] if m.start() else " "), (s[m.end()] if m.end() < len(s) else " ")
            blank = lambda c: c.isspace()
            mark = lambda c: unicodedata.category(c)[0] in "PS"
            left = not blank(nxt) and (not mark(nxt) or blank(prev) or mark(prev))
            right = not blank(prev) and (not mark(prev) or blank(nxt) or mark(nxt))
            if m.group()[0] == "_":
                left, right = left and (not right or mark(prev)), right and (not left or mark(nxt))
            runs.append((len(pieces), m.group()[0], len(m.group()), left, right))
            pieces.append(m.group())
            last = m.end()
        if hi > last:
            pieces.append(_safe(s[last:hi]))

    end = 0
    for m in PIECE.finditer(s):
        put_text(end, m.start())
        end = m.end()
        escaped, ticks, code, bang, label, address, title, auto, tag, hard = m.groups()
        if escaped:
            pieces.append(html.escape(escaped).replace("&#x27;", "'"))
        elif ticks:
            code = code.replace("\n", " ")
            code = code[1:-1] if code.startswith(" ") and code.endswith(" ") and code.strip() else code
            pieces.append(code if plain else f"<code>{html.escape(code).replace('&#x27;', chr(39))}</code>")
        elif label is not None:
            named = f' title="{_safe(title[1:-1])}"' if title else ""
            if bang:
                alt = inline_html(label, plain=True)
                pieces.append(alt if plain else f'<img src="{_address(address)}" alt="{alt}"{named} />')
            else:
                inner = inline_html(label, plain)
                pieces.append(inner if plain else f'<a href="{_address(address)}"{named}>{inner}</a>')
        elif auto:
            pieces.append(_safe(auto) if plain else f'<a href="{_address(auto)}">{_safe(auto)}</a>')
        elif tag:
            pieces.append("" if plain else tag)
        else:
            pieces.append("<br />\n" if hard and not plain else "\n")
    put_text(end, len(s))
    _emphasis(pieces, runs)
    whole = "".join(pieces)
    return re.sub(r"</?(?:em|strong)>", "", whole) if plain else whole


@F.pandas_udf(StringType())
def inline(text: pd.Series) -> pd.Series:
    """Inline Markdown as HTML, once for each different text of a batch: code, links, images, emphasis, breaks; HTML passes. Null is empty."""
    codes, values = pd.factorize(text.fillna(""))
    made = [inline_html(v) for v in values]
    return pd.Series([made[c] for c in codes], dtype=object)


def html_documents(segs: DataFrame, keys: list[str], columns: int = 2) -> DataFrame:
    """(keys, html): pages from segments; every element names its segment."""
    runs = _runs(segs, keys, [])
    w = Window.partitionBy(*keys).orderBy("ord")
    last = F.lead("run").over(w).eqNullSafe(F.col("run")) == F.lit(False)
    ident, t, i = T.html_escape(F.col("id")), F.col("shown"), inline(F.col("shown"))
    data = F.concat(F.lit(' data-token="'), ident, F.lit('"'))
    level = F.coalesce(F.try_to_number(meta("level", "1"), F.lit("9")).cast("int"), F.lit(1)).cast("string")
    tag = lambda name, inner: F.concat(F.lit(f"<{name}"), data, F.lit(">"), inner, F.lit(f"</{name}>"))
    first, place = F.col("place") == 0, F.col("place")
    item = F.concat(F.when(first, "<ul>\n").otherwise(""), tag("li", i), F.when(last, "\n</ul>").otherwise(""))
    ends = (place % columns == columns - 1) | last
    cell = F.concat(F.when(first, "<table><tbody>\n").otherwise(""), F.when(place % columns == 0, "<tr>").otherwise(""), tag("td", i), F.when(ends, "</tr>").otherwise(""), F.when(last, "\n</tbody></table>").otherwise(""))
    kind = T.html_escape(meta("admonition_type", "note"))
    piece = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(' id="'), ident, F.lit('"'), data, F.lit(">"), i, F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "paragraph", tag("p", i))
        .when(F.col("kind") == "list_item", item)
        .when(F.col("kind") == "blockquote", tag("blockquote", i))
        .when(F.col("kind") == "table_cell", cell)
        .when(F.col("kind") == "code_block", F.concat(F.lit("<pre"), data, F.lit('><code class="language-'), T.html_escape(meta("lang", "")), F.lit('">'), T.html_escape(t), F.lit("</code></pre>")))
        .when(F.col("kind").isin(*HELPERS), F.concat(F.lit("<span hidden"), data, F.lit(">"), T.html_escape(t), F.lit("</span>")))
        .when(F.col("kind") == "admonition_title", F.concat(F.lit('<div class="admonition admonition-'), kind, F.lit('"><div class="admonition-title"'), data, F.lit(">"), i, F.lit("</div>")))
        .when(F.col("kind") == "admonition_body", F.concat(F.lit('<div class="admonition-body"'), data, F.lit(">"), i, F.lit("</div></div>")))
        .otherwise(t)
    )
    glue = F.when((F.col("kind") == "table_cell") & (place % columns != 0), "").otherwise("\n")
    return runs.withColumn("piece", F.concat(glue, piece)).groupBy(*keys).agg(F.regexp_replace(ordered(F.col("piece"), ""), r"\A\n", "").alias("html"))


def page_html(pages: DataFrame, keys: list[str], nav: Column, toc: Column, css: str = "", search: str = "", inspect: bool = False) -> DataFrame:
    """(keys, html): whole pages around ``html``; nav and toc are HTML, empty where a page has none. css, search: the same for all pages.

    inspect marks the page's body, so that a style sheet can point out segments.
    """
    aside = F.when(T.text_or_empty(toc) == "", "").otherwise(F.concat(F.lit('<aside class="toc"><strong>On this page</strong><ul>'), toc, F.lit("</ul></aside>")))
    around = lambda tag: F.when(T.text_or_empty(nav) == "", "").otherwise(F.lit(tag))
    menu = [around('<nav class="sidebar"><strong>Docs</strong>'), T.text_or_empty(nav), around("</nav>")]  # beside the rest, not in a text of its own: the links may be megabytes
    head = f'<!doctype html>\n<html><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><style>{css}</style></head><body class="{"inspect" if inspect else ""}">\n'
    body = F.concat(F.lit(head), *menu, F.lit(f'{search}\n<main class="content">'), T.text_or_empty(F.col("html")), F.lit("</main>"), aside, F.lit("\n</body></html>\n"))
    return pages.select(*keys, body.alias("html"))


def navigation(pages: DataFrame) -> DataFrame:
    """(nav): one row, the links to all pages (url, title, page_order) in order; a null title shows the address."""
    url = F.regexp_replace(T.text_or_empty(F.col("url")), "^/+", "")
    title = F.coalesce("title", "url", F.lit(""))
    link = F.concat(F.lit('<a class="nav-link" href="/'), T.html_escape(url), F.lit('">'), T.html_escape(title), F.lit("</a>"))
    item = F.struct(F.coalesce("page_order", F.lit(999)).alias("o"), title.alias("t"), url.alias("u"), link.alias("v"))
    return pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), "\n").alias("nav"))


def shown(catalogue: DataFrame) -> DataFrame:
    """catalogue with ``shown``: the target if there is one, else the source."""
    return catalogue.withColumn("shown", T.text_or_empty(resolved("target", "target", "source")))


def contents(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, toc): the headings as a list of links, in order."""
    line = F.concat(F.lit('<li><a href="#'), T.html_escape(F.col("id")), F.lit('">'), T.html_escape(F.col("shown")), F.lit("</a></li>"))
    return shown(catalogue.filter("kind = 'heading'")).groupBy(*keys).agg(ordered(line, "\n").alias("toc"))


def diagrams(segs: DataFrame) -> DataFrame:
    """Code blocks in the diagram language become frozen HTML blocks."""
    is_one = (F.col("kind") == "code_block") & (F.trim(meta("lang", "")) == "mermaid")
    div = F.concat(F.lit('<div class="mermaid" data-token="'), T.html_escape(F.col("id")), F.lit('">'), T.html_escape(resolved("target", "target", "source")), F.lit("</div>"))
    return segs.withColumns({"target": F.when(is_one, div).otherwise(F.col("target")), "frozen": F.when(is_one, True).otherwise(F.col("frozen")), "kind": F.when(is_one, "html_block").otherwise(F.col("kind"))})
