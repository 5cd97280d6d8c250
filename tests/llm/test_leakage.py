import random

from verbaloom.llm import leakage as K


def grams(text, n):
    w = K.words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def data(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(3, 25)))) for i in range(20)]
    docs = []
    for d in range(60):
        t = [r.choice(words) for _ in range(r.randrange(0, 60))]
        if d % 3 == 0:
            w = items[r.randrange(20)][1].split()
            a = r.randrange(0, max(1, len(w) - 5))
            at = r.randrange(0, len(t) + 1)
            t[at:at] = w[a : a + r.randrange(4, 14)]
        docs.append((d, ", ".join(x.upper() if r.random() < 0.3 else x for x in t)))
    return items, docs


def test_leaks_equal_brute_force_and_removal_clears_them(spark):
    items, docs = data(2)
    idf = spark.createDataFrame([*items, (0, items[0][1]), (99, None), (98, "")], "item_id long, text string")
    ddf = spark.createDataFrame([*docs, docs[0], (900, None), (901, ""), (902, (items[5][1] + " ") * 3000)], "doc_id long, text string")
    for most in (2_000_000, 20):
        got = {(r.doc_id, r.item_id) for r in K.leaks(ddf, "doc_id", "text", idf, "item_id", "text", n=6, most=most).collect()}
        want = {(d, i) for d, t in [*docs, (902, (items[5][1] + " ") * 3000)] for i, x in items if grams(t, 6) & grams(x, 6)}
        assert got == want
    cut = {r.doc_id: r for r in K.remove_leaks(ddf, "doc_id", "text", idf, "item_id", "text", n=6).collect()}
    assert cut[900].clean is None and cut[901].clean == ""
    left = [(d, r.clean) for d, r in cut.items() if r.clean]
    gone = {d for d, r in cut.items() if r.removed_words}
    assert gone == {d for d, _ in want}
    again = K.leaks(spark.createDataFrame(left, "doc_id long, text string"), "doc_id", "text", idf, "item_id", "text", n=6)
    assert again.count() <= 2  # words on both sides of a cut may meet


def test_twelve_words_exactly(spark):
    item = " ".join(f"a{i}" for i in range(12))
    idf = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item.upper()}! y"), (2, " ".join(item.split()[:11]) + " z"), (3, item.replace(" ", "-"))], "doc_id long, text string")
    assert sorted(r.doc_id for r in K.leaks(docs, "doc_id", "text", idf, "item_id", "text").collect()) == [1, 3]
    assert K.leaks(docs, "doc_id", "text", idf.limit(0), "item_id", "text").count() == 0
    assert K.leaks(docs.limit(0), "doc_id", "text", idf, "item_id", "text").count() == 0


def test_cuts_where_lower_case_changes_the_length(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    text = f"İstanbul İzmir test {passage} end"
    words, spans = K.placed_words(text)
    assert words == K.words_of(text) and [text[a:b] for a, b in spans][-2:] == ["w11", "end"]
    docs, items = spark.createDataFrame([(1, text), (2, None), (3, "İ")], "doc_id long, text string"), spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r.doc_id: (r.clean, r.removed_words) for r in K.remove_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {1: ("İstanbul İzmir test  end", 12), 2: (None, 0), 3: ("İ", 0)}
