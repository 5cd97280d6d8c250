import pytest

from verbaloom.llm import canonical as K

SAME = [("Größe", "Größe"), ("file", "ﬁle"), ("Ｆｕｌｌ　Ｗｉｄｔｈ", "Full Width"), ("a b", "a b"), ("a​b­", "ab"), ("ае", "ae"), ("ΑΒΕ", "ABE"), ("x‐y", "x-y"), ("a b", "a b"), ("﻿a", "a"), ("ﬀ", "ff")]
DIFFERENT = [("Grosse", "Große"), ("a", "A"), ("resume", "résumé"), ("a.", "a"), ("a b", "ab"), ("a-b", "a–b"), ("l", "I")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert K.display_form(a) == K.display_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert K.display_form(a) != K.display_form(b)


def test_idempotent_and_key():
    for a, b in SAME:
        assert K.display_form(K.display_form(a)) == K.display_form(a) and K.comparison_key(a) == K.comparison_key(b)
    assert K.comparison_key("STRASSE") == K.comparison_key("straße") and K.display_form(None) is None and K.comparison_key(None) is None


def test_look_alikes(spark, rows):
    left = spark.createDataFrame([(1, "Größe x"), (1, "Größe x"), (2, "Grösse x"), (3, None), (4, ""), (5, "plain"), (6, "Größe x"), (7, "GRÖßE X")], "pair_id long, source string")
    right = spark.createDataFrame([(10, "Größe x"), (11, "Größe x"), (12, None), (13, "​"), (14, "plain"), (14, "plain")], "entry_id long, source string")
    assert rows(K.look_alikes(left, "pair_id", "source", right, "entry_id", "source")) == [(1, 11), (6, 10), (6, 11)]
    assert K.look_alikes(left.limit(0), "pair_id", "source", right, "entry_id", "source").count() == 0


def test_forms(spark):
    df = spark.createDataFrame([(1, "Ａ"), (2, None), (3, "​ "), (4, "ß" * 100_000)], "id long, source string")
    got = {r.id: (r.form, r.key) for r in K.canonical(df, "id", "source").collect()}
    assert got[1] == ("A", "a") and got[2] == (None, None) and got[3] == ("", "") and got[4][1] == "ss" * 100_000


def test_forms_of_both_tables(spark, rows, tmp_path):
    from verbaloom.llm.queries import p5_forms

    spark.createDataFrame([(1, "Ａ b"), (1, "Ａ b"), (2, None)], "pair_id long, source string").write.parquet(f"{tmp_path}/demo.parquet")
    spark.createDataFrame([(1, "A b"), (7, "ﬁle"), (7, "ﬁle")], "entry_id long, source string").write.parquet(f"{tmp_path}/tm_entries.parquet")
    assert rows(p5_forms(spark, str(tmp_path)).select("table", "id", "form", "key")) == [("demo", 1, "A b", "a b"), ("demo", 2, None, None), ("tm_entries", 1, "A b", "a b"), ("tm_entries", 7, "file", "file")]
