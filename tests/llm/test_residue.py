import random

import pytest

from verbaloom.llm import residue as R

PLAIN = "The lists sort the folders step by step. See also the pages."
TEMPLATES = ["{{ title }}", "As of ${VERSION}.", "# {%= page.title %}", "- #{SITE_NAME}", "Welcome to {{ name }}, kept by [[add contact]].", "Welcome to {{ name }}."]
SLOTS = ["- [[add contact]]", "<<Insert title here>>", "Welcome to [PRODUCT NAME].", "<TODO: text follows>", "__SITE_NAME__", "%customerName%", "{release_date}", "# <Insert title here>"]
FILLERS = [
    "Lorem ipsum dolor sit amet tempor elit.", "Sample text, replace before publishing. Sample text, replace before publishing. Sample text, replace before publishing.",
    "asdf asdf qwer jkl test test 123.", "Bla bla bla, Inhalt folgt, bla bla. Bla bla bla, Inhalt folgt, bla bla. Bla bla bla, Inhalt folgt, bla bla.",
]
MESSAGES = ["# 404 Page not found", "HTTP 403: Access denied", "HTTP 503: Dienst nicht verfügbar", "Service indisponible (503)", "<noscript>This app needs scripts. Your browser has them turned off.</noscript>"]
NEAR = ["**PAGE NOT FOUND**", "ACCESS DENIED", "Dienst nicht verfügbar", "### Service indisponible", "This app needs scripts. Your browser has them turned off.", "Read on. This app needs scripts.\nYour browser has\nthem turned off. Thanks.", "Sample text, replace before publishing.", "Bla bla bla, Inhalt folgt, bla bla."]
WITHOUT = [
    "The placeholder `{{ title }}` is replaced.", "```\n{{ title }}\n```", "A [link](http://x.y) and [ ] a box", "- [ ] task\n- [x] done", "See [1] and [^2] and <b>bold</b> <br/>.", "If the service returns code 404, it shows the message \"Page not found\" in the log and carries on.",
    "It reports dummy copy and lorem ipsum remains as errors.", "It shows all texts even without JavaScript, only the search is missing.", "100 % of 5 % cases", "~~~js\nshow('${x}')\n~~~", PLAIN, "Welcome to Berlo.", "| a b c | a b c | a b c |", "needs at least\n404 pages of\n500 (503", "Sunt", "Wer oder was", "It keeps a [draft] of each page for the editors.",
]


@pytest.fixture(scope="module")
def found(spark):
    texts = dict(enumerate(TEMPLATES + SLOTS + FILLERS + MESSAGES + NEAR))
    rows = [(i, f"{PLAIN}\r\n\r\n{t}\n\nEnd.") for i, t in texts.items()] + [(100 + i, f"{PLAIN}\n\n{t}\n\nEnd.") for i, t in enumerate(WITHOUT)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, (PLAIN + "\n") * 4000 + "This app always needs scripts. Your browser has them turned off."), (0, rows[0][1]), (None, "{{ x }}")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, unit string")
    return {r.doc_id: (r.kinds, r.linked) for r in R.residue(df, "doc_id", "text").collect()}


def test_cases_and_decoys(found):
    assert set(found) - {203} == set(range(len(TEMPLATES + SLOTS + FILLERS + MESSAGES + NEAR)))


def test_only_structure_is_trusted(found):
    kinds = ["placeholder"] * len(TEMPLATES + SLOTS) + ["filler"] * len(FILLERS) + ["message"] * (len(MESSAGES) + 6) + ["filler"] * 2
    linked = [False] * len(TEMPLATES) + [True] * len(SLOTS) + [False] * len(FILLERS + MESSAGES) + [True] * len(NEAR)
    assert [found[i] for i in range(len(kinds))] == list(zip(kinds, linked, strict=True))


def test_near_duplicates_of_trusted_lines(found):
    assert found.get(203) == ("message", True)
    assert R.near("a b c d e", "a b c d x") < 0.81 < R.near("a b c d e f g h i j", "a b c d e f g h i")


ALPHABET = {"de": "aeiouäüßnrst", "en": "aeiouyshtrnl", "es": "aeiouñárslnd", "fr": "aeiouéèçrlnt", "it": "aeiouàòrltnz", "nl": "aeiouijkgnrd"}


def invented(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_held_out_messages_in_six_languages(spark):
    """1500 variants of 300 invented messages, each seen once in a trusted structure; 1500 decoys that quote them."""
    rng, rows, want, decoys, ident = random.Random(5), [], set(), set(), 0
    for letters in ALPHABET.values():
        vocabulary = invented(rng, letters, 400)
        for k in range(50):
            words = rng.sample(vocabulary, rng.randrange(6, 9))
            text = " ".join(words)
            seed = f"<noscript>{text}.</noscript>" if k % 2 else f"HTTP 503: {text}"
            more, less = list(words), list(words)
            more.insert(rng.randrange(len(more)), rng.choice(vocabulary))
            less.pop(rng.randrange(len(less)))
            variants = [f"**{text}**", text.upper(), " ".join(more), " ".join(less), f"{' '.join(rng.sample(vocabulary, 5))}. {text.capitalize()}. {' '.join(rng.sample(vocabulary, 5))}."]
            about = [f"{' '.join(rng.sample(vocabulary, 6))} „{text}“ {' '.join(rng.sample(vocabulary, 6))}." for _ in range(5)]
            rows.append((ident, f"# {' '.join(rng.sample(vocabulary, 3))}\n\n{seed}"))
            for body, mark in [(v, want) for v in variants] + [(a, decoys) for a in about]:
                ident += 1
                mark.add(ident)
                rows.append((ident, f"{' '.join(rng.sample(vocabulary, 9))}\n\n{body}\n\n{' '.join(rng.sample(vocabulary, 9))}"))
            ident += 1
    got = R.residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    linked = {r.doc_id for r in got if r.linked}
    assert len(want) == 1500 and len(linked & want) >= 0.95 * len(want)
    assert len(linked & want) >= 0.99 * len(linked) and not linked & decoys


def test_labels_follow_links_and_differ_by_kind(spark):
    chain = ["alo beno cari demo eli fanu gora hilu imo", "alo beno cari demo eli fanu gora hilu", "alo beno cari demo eli fanu gora"]
    rows = [(0, f"HTTP 500: {chain[0]}"), (1, chain[1]), (2, chain[2]), (3, "asdf qwer jkl"), (4, "Kept by ${x} since {{ y }}."), (5, "Kept by [owner name] since <add date>."), (6, "Kept by Berlo since May.")]
    got = {r.doc_id: r.kinds for r in R.residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {0: "message", 1: "message", 2: "message", 3: "filler", 4: "placeholder", 5: "placeholder"}


def test_the_join_without_a_broadcast_finds_the_same(spark):
    rows = [(i, t) for i, t in enumerate(MESSAGES + NEAR)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, R.residue(df, "doc_id", "text", small=0).collect())) == sorted(map(tuple, R.residue(df, "doc_id", "text").collect()))


def test_keys_meet_within_eleven_bits():
    changes, rng = set(R.masks()), random.Random(3)
    assert len(changes) == 137
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 11))
        assert any((flips >> R.WIDTH * t) & 0xFFFF in changes for t in range(R.TABLES))


def test_empty_table(spark):
    assert R.residue(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_skeletons():
    assert list(R.skeletons("Blah blah. Blah blah.")) == [(("blah",), R.PLAIN)] * 2 and R.core(next(R.skeletons("HTTP 404: Page not found"))[0]) == ("page", "not", "found")
    assert R.lines_of("a\n```\nb\n```\nc `d` e") == ["a", "c  \x03  e"] and R.lines_of("a\n```\nunclosed") == ["a"]
    assert list(R.wrapped(["# A", "One.", "Two", "parts.", "", "Three"])) == ["One. Two parts."]
    assert R.units_of("One two. One two.") == {("one", "two"): R.PLAIN}
    assert R.units_of("One two one. One two one. One two one.") == {("one", "two", "one"): R.FILLER}
    assert R.units_of("A {{ x }} b. C [d e] f.") == {("a", "\x01", "b"): R.TEMPLATE, ("c", "\x01", "f"): R.SLOT}
