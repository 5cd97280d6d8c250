import numpy as np
import pytest

from verbaloom.llm import language as L

SAMPLES = {
    "de": "der die das und ist nicht mit von ein eine wenn seit danach weder noch werden die Listen und die Ordner sortieren",
    "en": "the and is not with of a an when since after that neither nor are kept while the lists and the folders sort",
    "fr": "le la les et est pas avec de un une quand depuis ensuite ni les listes et les dossiers trient pendant que",
}


def texts(n, seed):
    g = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(SAMPLES)[i % 3]
        w = SAMPLES[lang].split()
        out.append((i, " ".join(g.choice(w, 9)).capitalize() + ".", lang))
    return out


@pytest.fixture(scope="module")
def net():
    rows = texts(600, 1)
    langs = sorted(SAMPLES)
    labels = np.array([langs.index(lang) for *_, lang in rows])
    labels[::40] = (labels[::40] + 1) % 3  # some wrong labels
    return L.train([L.as_bytes(t) for _, t, _ in rows], labels, langs, hidden=16, steps=120, batch=48)


def test_gradients_equal_differences():
    net = L.Network(["a", "b"], 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, sizes = L.rows_of([b"abca", b"cb"])
    label = np.array([0, 1])

    def loss():
        y = net._logits(x, sizes, False)[0].astype(np.float64)
        y = y - np.log(np.exp(y).sum(2, keepdims=True))
        return -sum(y[t, i, label[i]] for i in range(2) for t in range(sizes[i])) / sizes.sum()

    g = net.gradients(x, sizes, label)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape) if k[1:] != "E" else (int(rng.choice([97, 98, 99])), int(rng.integers(0, 9)))
            old, eps = v[at], 1e-3
            v[at] = old + eps
            up = loss()
            v[at] = old - eps
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 5e-3, k


def test_held_out_accuracy(net):
    rows = texts(300, 2)
    p = L.label_parts(net, [t for _, t, _ in rows])
    right = [net.langs[i] == lang for i, (*_, lang) in zip(p.argmax(1), rows)]
    assert np.mean(right) > 0.97


def test_segments_leave_out_code_and_links():
    assert L.segments_of("Eins `the code`. Two (three) / vier\n\n- fünf [six](http://the.link)") == ["Eins  ` .", "Two", "three", "vier", "fünf [six ]"]
    assert L.segments_of(None) == [] and L.segments_of("123 `x` ...") == []


def test_languages_of_texts(spark, net):
    de, en = "Der Ordner und die Listen sind nicht mit von der.", "The folders and the lists are not kept with the."
    rows = [(1, de, None), (2, f"{de} ({en})", "de"), (3, None, "x"), (4, " ", "x"), (5, f"{de} `the and is not with of a an when`", "de"), (6, en * 2000, "fr"), (7, f"{de[:-1]} mit „the list“.", "DE_at")]
    df = spark.createDataFrame(rows, "id long, text string, found_lang string")
    got = {}
    for r in L.languages(df, "id", "text", net).collect():
        got.setdefault(r.id, set()).add(r.found_lang)
        assert 0 < r.confidence <= 1
    assert got == {1: {"de"}, 2: {"de", "en"}, 5: {"de"}, 6: {"en"}, 7: {"de"}}
    parts = L.languages(df.filter("id = 2"), "id", "text", net, by_segment=True).collect()
    assert [(r.segment, r.found_lang) for r in sorted(parts, key=lambda r: r.segment)] == [(0, "de"), (1, "en")]
    assert L.languages(df.limit(0), "id", "text", net).count() == 0


def test_mislabelled(spark):
    rows, new = texts(900, 3), [t for _, t, _ in texts(6, 8)]
    odd = [(1000, new[0], "en"), (1001, new[1], None), (1002, new[2], " FR-ca "), (1003, new[3], "xx"), *[(1004, new[3] + "\n" + new[4], "de")] * 2]
    df = spark.createDataFrame(rows + odd, "entry_id long, target string, lang string")
    got = sorted((r.id, r.found_lang) for r in L.mislabelled(df, "entry_id", "target", "lang", sorted(SAMPLES)).collect() if r.id >= 1000)
    assert got == [(1000, "de"), (1001, "en"), (1003, "de"), (1004, "de"), (1004, "en")]
    assert L.mislabelled(df.limit(0), "entry_id", "target", "lang", sorted(SAMPLES)).count() == 0
