"""Queries over whole tables for which SQL sees a part only, against brute force on small tables and the smallest test tables."""

import difflib
import html
import os
import re
from collections import Counter

import pytest

from verbaloom.operators import terms
from verbaloom.operators.exchange import inline_html
from verbaloom.plans.catalogue import QUERIES

BASE = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


def plain_terms(texts):
    scores = Counter()
    for t in texts:
        for m in re.finditer(terms.PHRASE.removeprefix("(?U)"), t or ""):
            if len(m.group(1).strip()) > 4:
                scores[m.group(1).strip()] += 3
        for w in re.findall(terms.WORD.removeprefix("(?U)"), t or ""):
            if w.lower() not in terms.STOP:
                capitals = w == w.upper() and w != w.lower() and len(w) > 2
                scores[w] += 1 + 2 * bool(re.search("[A-ZÄÖÜ]", w[1:])) + 2 * capitals + bool(re.search("[-_]", w)) + (len(w) > 10)
    return dict(scores)


def test_terms_of_texts_beyond_ascii(spark, tmp_path):
    texts = ["Die Übersetzung prüft Größe und MyTool – „Neue Ordner“", "Le système gère l’API Été Café", "plain API text", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("übersetzung", "x", None)], "source string, target string, note string").write.parquet(f"{tmp_path}/glossary.parquet")
    got = {r.term: r.score for r in QUERIES["term_scores"](spark, str(tmp_path)).collect()}
    assert got == plain_terms(texts)
    assert got["API"] == 10 and got["MyTool"] == 3 and got["Größe"] == 1 and got["Neue Ordner"] == 3
    best = QUERIES["term_topk"](spark, str(tmp_path)).collect()
    assert [(r.term, r.score) for r in best] == sorted(((t, n) for t, n in got.items() if n >= 5), key=lambda x: (-x[1], x[0]))
    fresh = {r.source for r in QUERIES["glossary_new_terms"](spark, str(tmp_path)).collect()}
    assert "Größe" in fresh and "Übersetzung" not in fresh


@here
def test_terms_of_all_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{BASE}/documents.parquet").select("text").collect()]
    assert {r.term: r.score for r in QUERIES["term_scores"](spark, BASE).collect()} == plain_terms(texts)


CATALOGUE = "pair_id long, doc_path string, lang string, ord int, id string, kind string, source string, target string, frozen boolean, fingerprint string, status string, meta string, extracted_at timestamp"


def demo(spark, folder, rows):
    """rows: dictionaries of what differs from a plain pair, numbered from 0."""
    plain = {"doc_path": "d", "lang": "de", "ord": 0, "id": "x", "kind": "p", "source": "s", "target": "t", "frozen": False, "fingerprint": "f", "status": "new", "meta": None, "extracted_at": None}
    names = [c.split()[0] for c in CATALOGUE.split(", ")]
    made = [{"pair_id": i} | plain | {"ord": i, "id": f"x{i}"} | r for i, r in enumerate(rows)]
    spark.createDataFrame([tuple(r[c] for c in names) for r in made], CATALOGUE).coalesce(1).write.parquet(f"{folder}/demo.parquet")
    return str(folder)


def pairs(spark, base):
    """The pairs of a folder's catalogue by number; repeated deliveries are equal but for their time."""
    return {r.pair_id: r for r in spark.read.parquet(f"{base}/demo.parquet").collect()}


def plain_tone(cat):
    found = {i: re.search(r"\b(du|dir|dein|dich|euch|ihr)\b", r.target or "", re.I) for i, r in cat.items() if not r.frozen}
    return sorted((i, m.group(1).lower()) for i, m in found.items() if m)


def plain_products(cat):
    name = re.compile(r"\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b")
    return sorted((i, p) for i, r in cat.items() if not r.frozen and r.target and r.source is not None for p in name.findall("MyTool " + r.source) if p not in r.target)


def plain_slug(s):
    s = re.sub(r"[^\w\s-]", "", (s or "").lower().strip())
    return re.sub("-+", "-", re.sub(r"[\s_]+", "-", s)).strip("-") or "section"


def same_as_plain(spark, rows, base):
    cat = pairs(spark, base)
    assert rows(QUERIES["ai_lint_tone"](spark, base)) == sorted(plain_tone(cat), key=repr)
    assert rows(QUERIES["ai_lint_product_case"](spark, base)) == sorted(plain_products(cat), key=repr)
    assert rows(QUERIES["slugify"](spark, base)) == sorted(((i, plain_slug(r.source)) for i, r in cat.items()), key=repr)
    return cat


def test_checks_and_slugs_beyond_ascii(spark, rows, tmp_path):
    base = demo(spark, tmp_path, [{"source": "Über PowerShell – ça", "target": "Für dich: geprüft"}, {"source": "Größe_ändern", "target": "début du café, éduqué, dué"}, {"source": "Grün\x1cİx ² PowerShellé", "target": "édu MyTool"}, {"source": None, "target": "du"}, {"source": "“”", "target": "Ihr Ziel é", "frozen": True}])
    cat = same_as_plain(spark, rows, base)
    assert plain_tone(cat) == [(0, "dich"), (1, "du"), (3, "du")] and (0, "PowerShell") in plain_products(cat)
    assert plain_slug(cat[1].source) == "größe-ändern" and plain_slug(cat[4].source) == "section"


@here
def test_checks_and_slugs_of_all_pairs(spark, rows):
    same_as_plain(spark, rows, BASE)


def same_markup_and_json(spark, rows, base):
    cat = pairs(spark, base)
    assert rows(QUERIES["json_repair"](spark, base)) == sorted(((i, r.target or "") for i, r in cat.items()), key=repr)
    lists = rows(QUERIES["translation_lists"](spark, base).select("batch", "id", "target", "ok"))
    assert lists == sorted(((str(i), r.id, r.target, True) for i, r in cat.items() if r.id is not None and r.target is not None), key=repr)
    blocks = rows(QUERIES["token_blocks"](spark, base).select("token", "tag", "text"))
    assert blocks == sorted(((r.id, "td", html.escape(r.source or "")) for r in cat.values() if r.id is not None), key=repr)
    assert rows(QUERIES["inline_html"](spark, base)) == sorted(((i, inline_html(r.target or r.source or "")) for i, r in cat.items()), key=repr)


def test_markup_and_json_that_sql_leaves_out(spark, rows, tmp_path):
    targets = ["`a`, }", "[1, ] und ```json", 'say "x, ]" \\ ,}', "a *b* und é_c_ _d_ `_e_ *f*` [g](/_h_/) *i_ _j `k` l_", None, "", ",]\n,\t}", "**a** *b c*, 2*3*4"]
    base = demo(spark, tmp_path, [{"target": t, "source": "<Tab a='1'> </td> *x*"} for t in targets])
    same_markup_and_json(spark, rows, base)
    got = {r.pair_id: r.html for r in QUERIES["inline_html"](spark, base).collect()}
    assert got[3] == 'a <em>b</em> und é_c_ <em>d</em> <code>_e_ *f*</code> <a href="/_h_/">g</a> *i_ <em>j <code>k</code> l</em>'


@here
def test_markup_and_json_of_all_pairs(spark, rows):
    same_markup_and_json(spark, rows, BASE)


def plain_merge(cat):
    last = {}
    for r in sorted(cat.values(), key=lambda r: (r.ord, r.pair_id)):
        last[r.lang, r.id] = r
    out = []
    for r in cat.values():
        own, e = "needs_review" if r.ord % 7 == 0 else "new", last[r.lang, r.id] if r.id is not None else None
        if e is None:
            out.append((r.pair_id, "", own))
        else:
            out.append((r.pair_id, e.target or "", "needs_review" if "needs_review" in (own, e.status) else "translated" if e.target else own))
    return sorted(out, key=repr)


def plain_sync(cat):
    cut = lambda r: "" if r.ord % 5 == 0 else r.target
    best = {}
    for r in sorted(cat.values(), key=lambda r: (r.ord, r.pair_id)):
        if r.fingerprint is not None and cut(r) and (r.status or "").strip(" ").lower() in ("translated", "needs_review"):
            k = (r.lang, r.fingerprint)
            if k not in best or (r.ord, r.id) >= (best[k].ord, best[k].id):
                best[k] = r
    return {r.pair_id: {(x.target, x.id) for x in cat.values() if (x.ord, x.id, x.lang, x.fingerprint) == (b.ord, b.id, b.lang, b.fingerprint)} for r in cat.values() if not r.frozen and not cut(r) and (b := best.get((r.lang, r.fingerprint)))}


def plain_po(cat):
    new = {}
    for r in cat.values():
        t = 'Neu "\\n\n' + r.target if r.ord % 2 == 0 and r.target else r.target or ""
        if not r.frozen and r.id is not None:
            k = (r.doc_path, r.lang, r.id)
            new[k] = max(new.get(k, ""), t)
    return sorted(((r.pair_id, n, "translated") if (n := new.get((r.doc_path, r.lang, r.id))) else (r.pair_id, r.target, r.status) for r in cat.values()), key=repr)


def plain_ids(cat):
    out = []
    for page, lang in sorted({(r.doc_path, r.lang) for r in cat.values() if r.lang != "en"}):
        used = set()
        mine, old = (sorted((r for r in cat.values() if r.doc_path == page and r.lang == x), key=lambda r: r.ord) for x in (lang, "en"))
        text = lambda r: " ".join((r.source or "").replace("\r\n", "\n").split())
        for r in mine:
            best, top = None, 0
            for o in old:
                if o.kind == r.kind and (r.kind, o.id) not in used and (n := difflib.SequenceMatcher(None, text(r), text(o)).ratio()) > top:
                    best, top = o, n
            if top >= 0.88:
                used.add((r.kind, best.id))
                out.append((page, lang, r.ord, best.id, "current" if best.fingerprint == r.fingerprint else "needs_review"))
            else:
                out.append((page, lang, r.ord, r.id, r.status))
    return sorted(out, key=repr)


def same_states(spark, rows, base):
    cat = pairs(spark, base)
    assert rows(QUERIES["catalog_merge"](spark, base)) == plain_merge(cat)
    sync, got = plain_sync(cat), QUERIES["branch_sync"](spark, base).collect()
    assert sorted(r.pair_id for r in got) == sorted(sync) and all((r.target, r.synced_from_id) in sync[r.pair_id] for r in got)
    assert rows(QUERIES["po_import_merge"](spark, base)) == plain_po(cat)


def test_states_of_every_language(spark, rows, tmp_path):
    made = [{"lang": lang, "ord": i, "id": f"x{i}", "target": f"{lang}{i}", "status": "translated", "fingerprint": f"f{i // 6}", "source": f"The number of the text is {i}"} for lang in ("en", "de", "it") for i in range(8)]
    base = demo(spark, tmp_path, made)
    same_states(spark, rows, base)
    got = {r.pair_id: r for r in QUERIES["catalog_merge"](spark, base).collect()}
    assert got[9].target == "de1" and got[17].target == "it1"
    synced = {r.pair_id: r.target for r in QUERIES["branch_sync"](spark, base).collect()}
    assert synced[8] == "de4" and synced[16] == "it4"
    merged = {r.pair_id: r.target for r in QUERIES["po_import_merge"](spark, base).collect()}
    assert merged[10] == 'Neu "\\n\nde2' and merged[11] == "de3"
    ids = rows(QUERIES["id_reuse_greedy"](spark, base).select("doc_path", "lang", "ord", "id", "status"))
    assert ids == plain_ids(pairs(spark, base)) and {r[1] for r in ids} == {"de", "it"}


@here
def test_states_of_all_pairs(spark, rows):
    same_states(spark, rows, BASE)
    assert rows(QUERIES["id_reuse_greedy"](spark, BASE).select("doc_path", "lang", "ord", "id", "status")) == plain_ids(pairs(spark, BASE))


@here
def test_writers_weigh_pages_one_by_one(spark, tmp_path):
    """A writer ends a group of rows by their size, also where fewer than 100 pages fill it."""
    import pyarrow.parquet as pq

    to = tmp_path / "pages"
    pages = QUERIES["site_pages"](spark, BASE).coalesce(1)
    pages.write.option("parquet.block.size", 4096).option("compression", "uncompressed").parquet(str(to))
    (made,) = to.glob("*.parquet")
    meta = pq.ParquetFile(made).metadata
    assert 4 < meta.num_rows < 100 and meta.num_row_groups > 1


def test_links_to_all_pages_are_stored_once_a_group(spark, tmp_path):
    """Pages begin with the same links: a file holds them once for each group of rows, and every page is read back whole."""
    import pyarrow.parquet as pq

    base = demo(spark, tmp_path, [{"doc_path": f"d{i}", "kind": "paragraph", "target": f"Text {i}"} for i in range(100)])
    index = [(f"d{i}", f"d{i}.html", f"Page {i * i}", i) for i in range(5000)]
    spark.createDataFrame(index, "source string, url string, title string, page_order int").write.parquet(f"{base}/site_index.parquet")
    pages = QUERIES["site_pages"](spark, base).coalesce(1)
    pages.write.parquet(f"{base}/pages")
    links = "\n".join(f'<a class="nav-link" href="/{u}">{t}</a>' for _, u, t, _ in index)
    (made,) = tmp_path.glob("pages/*.parquet")
    meta = pq.ParquetFile(made).metadata
    assert [meta.row_group(g).num_rows for g in range(meta.num_row_groups)] == [64, 36]  # a reader makes whole texts of one group at once
    assert made.stat().st_size < len(links)
    assert sum(meta.row_group(g).column(2).total_uncompressed_size for g in range(2)) < 2.5 * len(links)
    read = {r.doc_path: r.html for r in spark.read.parquet(f"{base}/pages").collect()}
    assert read == {r.doc_path: r.html for r in pages.collect()} and len(read) == 100
    assert all(links in html and f">Text {p[1:]}<" in html for p, html in read.items())
    assert spark.conf.get("parquet.block.row.count.limit", None) is None and spark.conf.get("parquet.writer.version", None) is None
