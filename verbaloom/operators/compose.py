"""Unstructured notes to items, items to modules, modules to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.functions import text as T

#: The modules in order, the words that route an item to one, and what a module is for.
MODULES = (
    ("Overview", ("idee", "ziel", "warum", "purpose", "overview", "problem", "mehrwert", "vision"), "Explain the purpose, scope, and value of the material."),
    ("Concepts", ("konzept", "begriff", "definition", "modell", "semantik", "token", "intent", "graph"), "Define the core concepts and vocabulary before implementation details."),
    ("Architecture", ("architektur", "pipeline", "system", "modul", "komponente", "server", "api", "datenbank", "sqlite"), "Describe the system structure, data flow, and component boundaries."),
    ("Workflow", ("workflow", "ablauf", "prozess", "schritt", "command", "befehl", "powershell", "bash", "cli"), "Describe the operational flow as reproducible steps."),
    ("Implementation", ("implementierung", "code", "python", "klasse", "funktion", "parser", "renderer", "provider"), "Turn implementation notes into concrete technical guidance."),
    ("Quality Assurance", ("qa", "test", "lint", "prüfung", "validierung", "review", "status", "ci", "dashboard"), "Capture validation, review, automation, and CI expectations."),
    ("Operations", ("deployment", "betrieb", "installation", "config", "umgebung", "key", "modell", "lm studio", "gemini"), "Describe setup, configuration, runtime, and operational concerns."),
    ("Risks and Open Questions", ("risiko", "frage", "unklar", "todo", "offen", "problem", "limitation", "fehler"), "Make uncertainty explicit instead of inventing missing facts."),
)
#: How questions begin, and parts of words that tell risks and steps.
QUESTIONS = ("wie ", "was ", "warum ", "wann ", "welche ", "wer ", "where ", "how ", "what ", "why ")
RISKS = "risiko problem fehler kaputt limitation unsicher unklar danger risk broken missing".split()
STEPS = "dann danach zuerst build extract render serve install pip schritt workflow".split()
OVERVIEW_MOST = 6
CAPS = {"claims": 12, "evidence": 18, "steps": 12, "risks": 12, "open_questions": 12}
DEFAULT_QUESTIONS = (
    "Which statements require human confirmation before publication?",
    "Which target audience is authoritative for wording and depth?",
    "Which examples, commands, or screenshots should be treated as canonical?",
)
DEFAULT_TITLE = "Generated Technical Documentation"
LINE_END = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def is_question(text: Column) -> Column:
    low = F.lower(F.trim(text))
    begins = F.lit(False)
    for p in QUESTIONS:
        begins = begins | F.startswith(low, F.lit(p))
    return F.contains(low, F.lit("?")) | begins


def is_risk(text: Column) -> Column:
    return _any(F.lower(text), RISKS)


def is_step(text: Column) -> Column:
    return _any(F.lower(text), STEPS)


def items(notes: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, item_index, text, kind, confidence): headings, bullets, statements and paragraphs outside fences."""
    w = Window.partitionBy("doc").orderBy("pos")
    raw = notes.select(F.col(doc).alias("doc"), F.posexplode(F.split(T.text_or_empty(F.col(text)), LINE_END)).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", f"^{T.BLANKS}|{T.BLANKS}$", ""))
    bullet = r"^(?:[-*+]\s+|\d+[.)]\s+|\[[ xX]\]\s+)(.+)$"
    typed = (
        raw.withColumn("line", line)
        .withColumn("fence", F.startswith("line", F.lit("```")).cast("int"))
        .withColumn("fences", F.sum("fence").over(w))
        .withColumn(
            "kind",
            F.when(F.col("fence") == 1, "fence")
            .when(F.col("fences") % 2 == 1, "code")
            .when(F.col("line") == "", "blank")
            .when(F.startswith("line", F.lit("#")), "heading")
            .when(F.col("line").rlike(bullet), "bullet")
            .when((F.length("line") < 160) & F.col("line").rlike("[:?]"), "statement")
            .otherwise("paragraph"),
        )
        .filter("kind <> 'code'")
    )
    start = F.when((F.col("kind") == "paragraph") & (F.lag("kind").over(w) == "paragraph"), 0).otherwise(1)
    islands = typed.withColumn("start", start).withColumn("island", F.sum("start").over(w)).filter("kind not in ('blank', 'fence')")
    own = (
        F.when(F.col("kind") == "heading", F.trim(F.regexp_replace("line", "^#+", "")))
        .when(F.col("kind") == "bullet", F.trim(F.regexp_extract("line", bullet, 1)))
        .otherwise(F.col("line"))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"]), " ")
    made = islands.withColumn("own", own).groupBy("doc", "island", "kind").agg(joined.alias("text")).filter("text <> ''")
    sure = F.when(F.col("kind") == "heading", 0.8).when(F.col("kind") == "bullet", 0.72).when(F.col("kind") == "statement", 0.7).otherwise(0.65)
    return made.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("island")).alias("item_index"), "text", "kind", sure.alias("confidence"))


def routed(found: DataFrame) -> DataFrame:
    """found with ``module``: the one with most of its words in the text (the first of equals), else by shape.

    The default is the overview until it holds six items, then the implementation: closed form, since every
    default item enters the overview while it has room, and no item leaves it.
    """
    low = F.lower("text")
    scores = [(name, sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0))) for name, words, _ in MODULES]
    best = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("o")) for i, (_, s) in enumerate(scores)])
    names = F.array(*[F.lit(n) for n, _ in scores])
    shaped = (
        F.when(is_question(F.col("text")) | is_risk(F.col("text")), "Risks and Open Questions")
        .when(is_step(F.col("text")), "Workflow")
        .when(F.col("kind") == "heading", "Concepts")
    )
    marked = found.withColumn("best", best).withColumn("sure", F.when(F.col("best.s") > 0, F.element_at(names, 1 - F.col("best.o"))).otherwise(shaped))
    counts = (F.col("sure").isNull() | (F.col("sure") == "Overview")).cast("int")
    before = F.sum(counts).over(Window.partitionBy("doc").orderBy("item_index").rowsBetween(Window.unboundedPreceding, -1))
    default = F.when(F.coalesce(before, F.lit(0)) < OVERVIEW_MOST, "Overview").otherwise("Implementation")
    return marked.withColumn("module", F.coalesce("sure", default)).drop("best", "sure")


def sorted_role(text: Column) -> Column:
    return F.when(is_question(text), "open_questions").when(is_risk(text), "risks").when(is_step(text), "steps").otherwise("claims")


def modules(items_routed: DataFrame) -> DataFrame:
    """(doc, module, title, slug, purpose, claims, evidence, steps, risks, open_questions, source_items).

    Lists keep the items' order and are cut to their caps, which belong to the form of a module. The overview
    and the risks exist for every document; the risks module also lists questions and risks found elsewhere.
    """
    role = items_routed.withColumn("role", sorted_role(F.col("text")))
    docs = items_routed.select("doc").distinct()
    fixed = docs.select("doc", F.explode(F.array(F.lit(1), F.lit(8))).alias("module"))
    number = F.create_map(*[F.lit(x) for i, (n, *_) in enumerate(MODULES, 1) for x in (n, i)])
    rows = role.withColumn("module", number[F.col("module")])

    def listed(condition, value=None, most=None):
        got = F.collect_list(F.when(condition, F.struct("item_index", (value if value is not None else F.col("text")).alias("t"))))
        out = F.transform(F.array_sort(got), lambda x: x["t"])
        return F.slice(out, 1, most) if most else out

    own = rows.groupBy("doc", "module").agg(
        *[listed(F.col("role") == r, most=CAPS[r]).alias(r) for r in ("claims", "steps")],
        *[listed(F.col("role") == r).alias(r) for r in ("risks", "open_questions")],
        listed(F.lit(True), F.concat(F.lit("Note #"), F.col("item_index"), F.lit(": "), F.col("text")), CAPS["evidence"]).alias("evidence"),
        listed(F.lit(True), F.col("item_index")).alias("source_items"),
    )
    whole = rows.groupBy("doc").agg(listed(is_question(F.col("text"))).alias("all_questions"), listed(is_risk(F.col("text"))).alias("all_risks"))
    empty = F.array().cast("array<string>")
    out = fixed.join(own, ["doc", "module"], "full").join(whole, "doc", "left")
    more = lambda a, b: F.when(F.col("module") == 8, F.concat(F.coalesce(a, empty), F.filter(F.coalesce(b, empty), lambda x: ~F.array_contains(F.coalesce(F.col(a), empty), x)))).otherwise(F.coalesce(F.col(a), empty))
    titles, purposes = F.array(*[F.lit(n) for n, *_ in MODULES]), F.array(*[F.lit(p) for *_, p in MODULES])
    return out.select(
        "doc", "module", F.element_at(titles, F.col("module")).alias("title"), T.slug(F.element_at(titles, F.col("module"))).alias("slug"), F.element_at(purposes, F.col("module")).alias("purpose"),
        *[F.coalesce(c, empty).alias(c) for c in ("claims", "evidence", "steps")],
        F.slice(more("risks", "all_risks"), 1, CAPS["risks"]).alias("risks"), F.slice(more("open_questions", "all_questions"), 1, CAPS["open_questions"]).alias("open_questions"),
        F.coalesce("source_items", F.array().cast("array<int>")).alias("source_items"),
    )


def titles(notes: DataFrame, found: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, title): the first heading line, else the first heading or statement of 6 to 90 characters, else a default."""
    first = F.regexp_extract(T.text_or_empty(F.col(text)), r"(?md)^[ \t]*#+(.*)$", 1)
    ok = F.col("kind").isin("heading", "statement") & F.length("text").between(6, 90)
    said = found.filter(ok).groupBy("doc").agg(F.min_by("text", "item_index").alias("said"))
    has = T.text_or_empty(F.col(text)).rlike(r"(?md)^[ \t]*#")
    return notes.select(F.col(doc).alias("doc"), F.when(has, F.trim(first)).alias("head")).join(said, "doc", "left").select("doc", F.coalesce("head", F.regexp_replace("said", ":+$", ""), F.lit(DEFAULT_TITLE)).alias("title"))


def global_questions(found: DataFrame) -> DataFrame:
    """(doc, questions): at most twenty questions in order, or three that always apply."""
    got = F.collect_list(F.when(is_question(F.col("text")), F.struct("item_index", "text")))
    listed = F.slice(F.transform(F.array_sort(got), lambda x: x["text"]), 1, 20)
    return found.groupBy("doc").agg(listed.alias("q")).select("doc", F.when(F.size("q") > 0, F.col("q")).otherwise(F.array(*[F.lit(q) for q in DEFAULT_QUESTIONS])).alias("questions"))


def open_questions(made: DataFrame, general: DataFrame) -> DataFrame:
    """(doc, place, line): every question once, first the general ones, then by module."""
    first = general.select("doc", F.lit(0).alias("m"), F.posexplode("questions").alias("pos", "q"), F.lit(None).cast("string").alias("title"))
    rest = made.select("doc", F.col("module").alias("m"), F.posexplode("open_questions").alias("pos", "q"), "title")
    once = first.unionByName(rest).groupBy("doc", "q").agg(F.min(F.struct("m", "pos", "title")).alias("f"))
    line = F.when(F.col("f.m") == 0, F.concat(F.lit("- "), F.col("q"))).otherwise(F.concat(F.lit("- **"), F.col("f.title"), F.lit("**: "), F.col("q")))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("f.m", "f.pos"))
    return once.select("doc", place.alias("place"), line.alias("line"))


def _section(title: str, rows: Column, numbered: bool = False, before: str = "") -> Column:
    lines = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)) if numbered else F.transform(rows, lambda x: F.concat(F.lit("- "), x))
    head = F.array(F.lit(f"## {title}"), F.lit(""), *([F.lit(before), F.lit("")] if before else []))
    return F.when(F.size(rows) > 0, F.concat(head, lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def _head(title: Column, document_type: str, audience: str) -> Column:
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.array(F.lit("---"), F.concat(F.lit("title: "), q(title)), F.lit(f'document_type: "{document_type}"'), F.lit(f'audience: "{audience}"'), F.lit("generated_by: notes-compose"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""))


def module_documents(made: DataFrame, document_type: str = "technical-guide", audience: str = "developers", trace: bool = True) -> DataFrame:
    """(doc, path, text): one Markdown document by module."""
    parts = [
        _head(F.col("title"), document_type, audience), F.array("purpose", F.lit("")), _section("Key Points", F.col("claims")), _section("Procedure", F.col("steps"), numbered=True),
        _section("Risks and Constraints", F.col("risks")), _section("Open Questions", F.col("open_questions")),
        *([_section("Traceability", F.col("evidence"), before="The following source notes support this section:")] if trace else []),
    ]
    return made.select("doc", F.concat("slug", F.lit(".md")).alias("path"), F.concat(F.rtrim(F.regexp_replace(F.array_join(F.concat(*parts), "\n"), r"\s+\z", "")), F.lit("\n")).alias("text"))


def index_documents(made: DataFrame, named: DataFrame, general: DataFrame, document_type: str = "technical-guide", audience: str = "developers") -> DataFrame:
    """(doc, path, text): the index of each document's modules."""
    links = F.transform(F.array_sort(F.collect_list(F.struct("module", "title", "slug"))), lambda m: F.concat(F.lit("- ["), m["title"], F.lit("](./"), m["slug"], F.lit(".md)")))
    both = made.groupBy("doc").agg(links.alias("links")).join(named, "doc").join(general, "doc")
    parts = [_head(F.col("title"), document_type, audience), F.array(F.lit("> This documentation was generated from unstructured notes."), F.lit("> It should be reviewed before publication."), F.lit("")), F.concat(F.array(F.lit("## Modules"), F.lit("")), F.col("links"), F.array(F.lit(""))), _section("Global Open Questions", F.col("questions"))]
    return both.select("doc", F.lit("index.md").alias("path"), F.concat(F.regexp_replace(F.array_join(F.concat(*parts), "\n"), r"\s+\z", ""), F.lit("\n")).alias("text"))


GRAPH = (
    "struct<title:string,document_type:string,audience:string,confidence:string,global_open_questions:array<string>,"
    "modules:array<struct<title:string,slug:string,purpose:string,claims:array<string>,evidence:array<string>,steps:array<string>,risks:array<string>,open_questions:array<string>,source_items:array<string>>>>"
)
MODEL_CAPS = {"claims": 16, "evidence": 20, "steps": 16, "risks": 16, "open_questions": 16}


def normalised_graph(replies: DataFrame, doc: str, reply: str) -> DataFrame:
    """(doc, module, title, slug, purpose, lists...) of a model's JSON replies; one that can't be read gives no rows.

    The caller unites the documents without rows with their heuristic modules.
    """
    graph = replies.select(F.col(doc).alias("doc"), F.from_json(F.col(reply), GRAPH).alias("g")).select("doc", F.posexplode("g.modules").alias("pos", "m"))
    title = F.coalesce(F.nullif(F.col("m.title"), F.lit("")), F.concat(F.lit("Section "), F.col("pos") + 1))
    kept = lambda c, n: F.slice(F.filter(F.coalesce(F.col(f"m.{c}"), F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, n)
    numbers = F.transform(F.filter(F.coalesce("m.source_items", F.array().cast("array<string>")), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))
    return graph.select("doc", (F.col("pos") + 1).alias("module"), title.alias("title"), T.slug(F.coalesce(F.nullif(F.col("m.slug"), F.lit("")), title)).alias("slug"), F.coalesce(F.nullif(F.col("m.purpose"), F.lit("")), F.lit("Organize related information.")).alias("purpose"), *[kept(c, n).alias(c) for c, n in MODEL_CAPS.items()], F.slice(numbers, 1, 50).alias("source_items"))
