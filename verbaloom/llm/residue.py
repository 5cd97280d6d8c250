"""Problem 8: template residue, filler, error pages and scripts-required notices.

A document is taken apart into units outside code: the sentences of its lines (a title or cell counts as one), and
of paragraphs that are wrapped over lines. A unit's skeleton is its words without markup, numbers, case and
repetitions, with every placeholder or run of pseudo-Latin reduced to one mark. No sentence is known
beforehand. Trusted labels come from the structure of a unit alone:

* a placeholder in the syntax of a template engine (``{{x}}``, ``{% x %}``, ``${x}``, ``#{x}``);
* mostly pseudo-Latin, keys struck along the rows of a keyboard, or a line that says one thing three times over;
* a line that is an HTTP status (``HTTP 503: ...``, ``# 503 ...``, ``... (503)``);
* what stands in a ``noscript`` element.

All else is found as a near-duplicate of a trusted unit. Units meet in partitioned tables of a 64-bit SimHash: four
tables of 16 bits, in which the searching side also looks up every key that differs in at most two bits, so that
units within eleven bits meet for certain. The Hamming distance and then the words are compared, verified links are
followed until no new unit is found, and connected components carry the labels. Possible placeholders in signs
that also serve other ends (``[x]``, ``{x}``, ``<x>``, ``%x%``, ``__x__`` ...) take part with the slot masked and link with masked units
only, since the same line with the slot filled in is as near. Documents are read once and in full; nothing is capped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.llm.graph import connected_components
from verbaloom.session import checkpointed, stored

FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
#: A code span ends in its own paragraph.
SPAN = re.compile(r"(?<!`)(`+)(?!`)((?:[^\n]|\n(?![ \t]*(?:\n|[-*+>#|]|\d+[.)])))+?)(?<!`)\1(?!`)")
OWN_SPAN = re.compile(r"`[^`\n]+`")
WORD = re.compile(r"[^\W\d_]+|[\x01\x02\x04]")
NAME = r"[^\W\d][\w.\-]*(?: [^\W\d][\w.\-]*){0,3}"  # an identifier or a few words
#: The syntax of template engines, which nothing else uses.
ENGINE = r"\{\{[^{}\n]*\}\}|\{%[^%{}\n]*%\}|[$#]\{[^{}\n]+\}"
#: Signs that stand around a placeholder, but also around a link of a wiki, strong text, a variable or a label.
SIGNS = (
    rf"<<[^<>\n]+>>|\[\[[^\[\]\n]+\]\]|(?<![\w%])%{NAME}%(?![\w%])|(?<!\w)__[^\W\d_][\w.]*[^\W_]__(?!\w)"
    rf"|(?<![{{$#%\w])\{{(?:TODO: ?)?{NAME}\}}(?!\}})|(?<![\[\]!\w])\[(?=[^\]]{{2}})(?:TODO: ?[^\[\]\n]+|{NAME})\](?![\[\](:])"
    r"|(?<![<\w])<(?:TODO: ?[^<>\n]+|[^\W\d]\w*(?: [^\W\d]\w*){1,3}|[A-Z][A-Z_]+|[a-z]+[A-Z_]\w+)>(?!>)"
)
SURE = re.compile(ENGINE)
MAYBE = re.compile(SIGNS)
HINT = re.compile(r"[{<\[%]|__")
TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
#: The codes of client and server errors in HTTP.
CODES = r"(?:40\d|41[0-8]|42[1-6]|428|429|431|451|50[0-8]|51[01])"
#: A status as a whole line: named by its protocol, a title that begins with the code, or a title with the code behind it.
STATUS = re.compile(rf"^\W*HTTP(?:/\d(?:\.\d)?)?\W{{0,3}}{CODES}\b\W*[^\d.]*$|^\s*(?:#|\*\*|__|<h\d>)\W*{CODES}\W{{1,3}}[^\W\d][^\d.]*$|^\W*[^\W\d][^\d.]*\((?:HTTP )?{CODES}\)\W*$", re.I)
NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", re.I | re.S)
SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)\]*_]*\s+")
#: What begins a block of its own, so that no paragraph runs on.
OWN = re.compile(r"^\s*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|\||:::|[-*_=]{3,}\s*$|<)")
#: Words of pseudo-Latin filler, without those that also are common words of today.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim "
    "minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit "
    "voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt "
    "mollit anim laborum vitae lectus felis sapien rutrum augue ornare cursus dapibus magnis mollis porta fermentum pulvinar "
    "varius accumsan aenean aliquam bibendum blandit condimentum congue convallis curabitur cras diam dictumst dignissim donec "
    "efficitur egestas eget eleifend eros etiam euismod facilisis faucibus feugiat finibus fringilla fusce gravida habitasse "
    "hendrerit iaculis imperdiet interdum justo lacinia lacus laoreet libero ligula lobortis luctus maecenas malesuada mattis "
    "mauris metus molestie morbi neque nibh nisl nunc odio orci pellentesque pharetra phasellus placerat platea porttitor "
    "posuere praesent pretium proin purus quisque rhoncus risus sagittis scelerisque semper sodales sollicitudin suscipit "
    "suspendisse tellus tempus tincidunt tortor tristique turpis ultrices ultricies urna vehicula vestibulum vivamus viverra "
    "volutpat vulputate".split()
)
#: Rows of letters on keyboards.
KEYS = "qwertyuiop asdfghjklö qwertzuiopü asdfghjklñ azertyuiop qsdfghjklm zxcvbnm yxcvbnm wxcvbn".split()
RUNS = frozenset(row[i:j] for row in KEYS for i in range(len(row)) for j in range(i + 3, len(row) + 1))
#: What an error message may be wrapped in.
AROUND = frozenset({"http", "https", "error", "fehler", "erreur", "errore", "fout", "status", "code"})
PLAIN, SLOT, TEMPLATE, FILLER, MESSAGE = range(5)  # SLOT: perhaps a placeholder; the last three are trusted
LABELS = {TEMPLATE: "placeholder", FILLER: "filler", MESSAGE: "message"}
TABLES, WIDTH = 4, 16


def masked(text: str) -> str:
    """The text outside code, with \\x03 for a code span."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    if "`" in text:
        # Where every line closes its own spans, a plainer pattern finds the same.
        own = "``" not in text and all(x.count("`") % 2 == 0 for x in text.split("\n"))
        text = (OWN_SPAN if own else SPAN).sub(" \x03 ", text)
    return text


def lines_of(text: str) -> list[str]:
    return [x for x in masked(text).split("\n") if x.strip()]


def wrapped(lines: list[str]) -> Iterator[str]:
    """Paragraphs that run over several lines, each as one line. lines: with the blank ones."""
    run: list[str] = []
    for line in [*lines, ""]:
        own = OWN.match(line) is not None
        if run and (own or not line.strip()):
            if len(run) > 1:
                yield " ".join(run)
            run = []
        if line.strip() and not (own and line.lstrip()[0] in "#|"):
            run.append(line)


def mashed(words: list[str]) -> bool:
    """Mostly keys struck one beside the other, in two different words at least."""
    return not RUNS.isdisjoint(words) and len(RUNS.intersection(words)) >= 2 and sum(w in RUNS for w in words) * 2 >= len(words)


def skeletons(line: str) -> Iterator[tuple[tuple[str, ...], int]]:
    """(words, kind) of each sentence of a line. \\x01 stands for a placeholder, \\x02 for pseudo-Latin."""
    marks = HINT.search(line) is not None
    bare = TAG.sub(" ", MAYBE.sub(" \x04 ", SURE.sub(" \x01 ", line))) if marks else line
    status = ("4" in line or "5" in line) and STATUS.match(bare) is not None
    parts = SENTENCE.split(bare) if SENTENCE.search(bare) else [bare]
    said = Counter(parts) if len(parts) > 2 else None
    again = said is not None and min(said.values()) > 2  # nothing but what is said three times over
    for part in said or parts:
        found = WORD.findall(part.casefold())
        kind = PLAIN
        if marks:
            kind = TEMPLATE if "\x01" in found else SLOT if "\x04" in found else PLAIN
            found = ["\x01" if w == "\x04" else w for w in found]
        out, n = found, len(found)
        latin = 0 if LATIN.isdisjoint(found) else sum(w in LATIN for w in found)
        if latin >= 3 and latin >= 0.3 * n:
            out = [w for k, w in enumerate("\x02" if w in LATIN else w for w in found) if w != "\x02" or k == 0 or found[k - 1] not in LATIN]
        m, times = len(out), 1
        if m > 1 and out.count(out[0]) > 1:  # what is said over and over counts once
            for period in range(1, m // 2 + 1):
                if m % period == 0 and out == out[:period] * (m // period):
                    out, times = out[:period], m // period
                    break
        if kind == PLAIN and found:
            if latin >= 3 and latin >= 0.6 * n or len(out) >= 3 and (again or times >= 3 and line.lstrip()[:1] != "|") or mashed(found):
                kind = FILLER
            elif status and len(parts) == 1 and n <= 12:
                kind = MESSAGE
        if out:
            yield tuple(out), kind


def core(words: tuple[str, ...]) -> tuple[str, ...]:
    """Without the frame of an error message."""
    if AROUND.isdisjoint(words):
        return words
    return tuple(w for w in words if w not in AROUND) or words


def units_of(text: str) -> dict[tuple[str, ...], int]:
    """The skeletons of a text's sentences, line by line and by paragraph, each with its kind."""
    text, found = masked(text), {}
    lines = text.split("\n")

    def take(line: str, least: int = PLAIN) -> None:
        for words, kind in skeletons(line):
            words = core(words)
            if max(kind, least) > found.get(words, -1):
                found[words] = max(kind, least)

    if "<noscript" in text.lower():
        for m in NOSCRIPT.finditer(text):
            take(m.group(1).replace("\n", " "), MESSAGE)
    for line in lines:
        if line.strip():
            take(line)
    for line in wrapped(lines):
        take(line)
    return found


def simhash(units: list[tuple[str, ...]], known: dict[str, int]) -> np.ndarray:
    """64 bits by unit, each the majority of its words' bits."""
    sizes = np.array([len(u) for u in units], np.int64)
    flat = [w for u in units for w in u]
    for w in set(flat).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    bits = np.unpackbits(np.array([known[w] for w in flat], np.uint64).view(np.uint8).reshape(-1, 8), axis=1)
    wide = np.uint16 if sizes.max() < 1 << 16 else np.int64
    ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=wide)
    return np.packbits(ones * np.int64(2) > sizes[:, None], axis=1).view(np.int64).ravel()


def unit_id(words: tuple[str, ...]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(" ".join(words))).view(np.int64))


def _units(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, unit, sim, n, kind, words): every different unit of every document; n words."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            for lo in range(0, len(pdf), 1500):
                if len(known) > 400_000:
                    known.clear()
                part = pdf.iloc[lo : lo + 1500]
                docs, units, kinds = [], [], []
                for doc, text in zip(part.doc_id, part.text, strict=True):
                    found = units_of(text)
                    docs += [doc] * len(found)
                    units += found.keys()
                    kinds += found.values()
                if units:
                    words = [" ".join(u) for u in units]
                    ids = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)
                    yield pd.DataFrame({"doc_id": docs, "unit": ids, "sim": simhash(units, known), "n": [len(u) for u in units], "kind": kinds, "words": words})

    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    return base.mapInPandas(split, "doc_id long, unit long, sim long, n int, kind int, words string")


def masks() -> list[int]:
    """All changes of at most two of the key's bits."""
    one = [1 << i for i in range(WIDTH)]
    return [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])]


def _keys(probing: bool) -> Column:
    """The unit's keys: table, whether it has a slot, and 16 of the 64 bits; the searching side adds the near keys."""
    bits = F.lit((1 << WIDTH) - 1).cast("long")
    own = [F.shiftrightunsigned("sim", WIDTH * t).bitwiseAND(bits).bitwiseOR(F.lit(t << WIDTH + 1).cast("long")).bitwiseOR(F.when(F.col("slot"), 1 << WIDTH).otherwise(0).cast("long")) for t in range(TABLES)]
    keys = F.array(*(k.cast("int") for k in own))
    if probing:
        changes = F.array(*map(F.lit, masks()))
        keys = F.flatten(F.transform(keys, lambda k: F.transform(changes, lambda m: k.bitwiseXOR(m))))
    return F.explode(keys).alias("key")


def near(a: str, b: str) -> float:
    """Share of common words in all words of two skeletons, with repetitions."""
    p, q = Counter(a.split(" ")), Counter(b.split(" "))
    n = (p & q).total()
    return n / (p.total() + q.total() - n)


def labels(documents: DataFrame, id_col: str, text_col: str, differ: int = 16, similar: float = 0.8, small: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, trusted units, labels of all units found).

    differ: most bits in which the SimHash of near units differs; similar: least similarity of their words;
    small: most searching units that are broadcast (548 keys each); beyond it the join shuffles. That changes no result.
    """
    units = stored(_units(documents, id_col, text_col))
    texts, slot = units.select("unit", "words"), F.col("kind").isin(SLOT, TEMPLATE).alias("slot")
    trusted = units.filter(F.col("kind") >= TEMPLATE).groupBy("unit", "sim", "n", slot).agg(F.max("kind").alias("kind"), F.first("words").alias("words"))
    trusted = checkpointed(trusted)
    others = units.filter(F.col("kind") < TEMPLATE).select("unit", "sim", "n", slot)
    labelled, frontier, links = trusted.select("unit"), trusted.drop("kind"), None

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)])

    while True:
        n = frontier.count()
        if not n:
            break
        probe = frontier.select(F.col("unit").alias("from"), F.col("sim").alias("other"), F.col("n").alias("m"), F.col("slot"), _keys(True))
        # A unit that many documents repeat is joined once: where the join shuffles, copies are combined before it.
        searched = (others if n <= small else others.distinct()).select("unit", "sim", "n", _keys(False))
        met = searched.join(F.broadcast(probe) if n <= small else probe, "key")
        # Texts this similar differ in length by no more than the similarity allows.
        met = met.filter((F.least("n", "m") >= F.greatest("n", "m") * similar) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("other"))) <= differ))
        met = checkpointed(met.select("unit", "sim", "n", "slot", "from").distinct().join(labelled.distinct(), "unit", "left_anti"))
        wanted = met.select("unit").distinct()
        size = wanted.count()
        if not size:
            break
        words = texts.join(F.broadcast(wanted) if size <= 50 * small else wanted, "unit").groupBy("unit").agg(F.first("words").alias("words"))
        pairs = met.join(words, "unit").join(frontier.select(F.col("unit").alias("from"), F.col("words").alias("of")), "from")
        linked = checkpointed(pairs.filter(likeness("words", "of") >= similar).select("unit", "from", "sim", "n", "slot", "words"))
        links = linked.select("unit", "from") if links is None else links.unionByName(linked.select("unit", "from"))
        frontier = checkpointed(linked.dropDuplicates(["unit"]).select("unit", "sim", "n", "slot", "words"))
        labelled = labelled.unionByName(frontier.select("unit"))

    found = trusted.select("unit", "kind")
    if links is not None:
        part = connected_components(links, "unit", "from")
        sure = part.join(trusted.select(F.col("unit").alias("node"), "kind"), "node").groupBy("component").agg(F.min("kind").alias("kind"))
        spread = part.join(sure, "component").select(F.col("node").alias("unit"), "kind")
        found = found.unionByName(spread.join(trusted, "unit", "left_anti"))
    return units, trusted, checkpointed(found)


def residue(documents: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(doc_id, kinds, linked): documents with residue; which: placeholder, filler or message, joined by commas; and
    whether none of it is trusted by its structure, so that the document is found by near-duplicates only.

    Null and blank texts have none; a document delivered twice counts once; an empty table gives no rows.
    """
    units, _, found = labels(documents, id_col, text_col, **options)
    named = F.broadcast(found) if found.count() <= 1_000_000 else found
    name = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    hits = units.select("doc_id", "unit", F.col("kind").alias("own")).join(named, "unit")
    kinds = F.array_join(F.array_sort(F.collect_set(name[F.col("kind")])), ",")
    return hits.groupBy("doc_id").agg(kinds.alias("kinds"), (F.max("own") < TEMPLATE).alias("linked"))
