import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from verbaloom.operators.catalogue import latest
from verbaloom.sources import files, sinks
from verbaloom.streaming import watch


def test_markdown_tree_and_hashes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Ä")
    (tmp_path / "sub/b.mdx").write_text("x")
    (tmp_path / "c.txt").write_text("no")
    assert sorted((r.path, r.text) for r in files.markdown(spark, str(tmp_path)).collect()) == [("a.md", "# Ä"), ("sub/b.mdx", "x")]
    assert files.hashes(spark, str(tmp_path)).count() == 3
    assert files.markdown(spark, str(tmp_path / "none")).count() == 0 and files.hashes(spark, str(tmp_path / "none")).count() == 0


def test_catalogues_manifests_memory_glossary(spark, tmp_path):
    put = lambda n, x: (tmp_path / n).write_text(json.dumps(x))
    for d in ("cat", "bad", "man", "tm", "glo"):
        (tmp_path / d).mkdir()
    put("cat/a.json", {"source": "a.md", "entries": [{"id": "1", "kind": "p", "source": "s", "target": "t", "frozen": False}, {"id": "2"}]})
    put("bad/a.json", {"source": "a.md"})
    put("man/a.json", {"source": "a.md", "nodes": [{"id": "1", "kind": "p", "source": "s", "fingerprint": "f"}]})
    put("tm/a.json", {"version": 1, "entries": {"k": {"source": "S", "target": "T", "last_segment_id": "x"}, "m": {"source": "", "target": "T"}}})
    put("tm/b.json", {"entries": [{"source": "L", "target": "M", "segment_id": "y"}]})
    put("glo/a.json", {"terms": [{"source": "a", "target": "b"}, {"term": "c"}, {"note": "n"}]})
    put("glo/b.json", [{"source": "d"}])
    got = files.catalogues(spark, str(tmp_path / "cat")).orderBy("ord").collect()
    assert [(r.doc_path, r.ord, r.id, r.target) for r in got] == [("a.md", 0, "1", "t"), ("a.md", 1, "2", None)]
    with pytest.raises(Exception, match="no 'entries'"):
        files.catalogues(spark, str(tmp_path / "bad")).collect()
    assert files.manifests(spark, str(tmp_path / "man")).first().src_text == "s"
    assert sorted((r.source, r.segment_id) for r in files.memory_json(spark, str(tmp_path / "tm"), "de").collect()) == [("L", "y"), ("S", "x")]
    assert sorted(r.source for r in files.glossary(spark, str(tmp_path / "glo")).collect()) == ["a", "c", "d"]


def test_memory_sqlite_of_an_older_form(spark, tmp_path):
    with sqlite3.connect(tmp_path / "tm.sqlite") as con:
        con.execute("create table tm_entries (source_key text, source text, target text, lang text)")
        con.execute("insert into tm_entries values ('k', 's', 't', 'de')")
    r = files.memory_sqlite(spark, str(tmp_path / "tm.sqlite")).first()
    assert (r.source_key, r.target, r.status) == ("k", "t", None)
    assert files.memory_sqlite(spark, str(tmp_path / "none.db")).count() == 0


def test_config_over_defaults(tmp_path):
    (tmp_path / "c.json").write_text('{"default_lang": "fr"}')
    assert files.config(str(tmp_path / "c.json"))["default_lang"] == "fr" and files.config(str(tmp_path / "x.json"))["source_dir"] == "docs"


def test_versions_are_never_overwritten(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert sinks.current(spark, root) is None
    first = sinks.write_version(spark.range(3).toDF("i"), root)
    now = spark.read.parquet(sinks.current(spark, root))
    second = sinks.write_version(now.unionByName(spark.range(10, 11).toDF("i")), root)
    assert first != second and spark.read.parquet(first).count() == 3 and spark.read.parquet(sinks.current(spark, root)).count() == 4


def test_write_texts(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", "Ä"), ("c.md", None)], "p string, t string")
    assert sorted(r.bytes for r in sinks.write_texts(df, "p", "t", str(tmp_path)).collect()) == [0, 2]
    assert (tmp_path / "a/b.md").read_text() == "Ä"
    with pytest.raises(Exception, match="outside the folder"):
        sinks.write_texts(df.withColumn("p", F.lit("../x")), "p", "t", str(tmp_path / "q")).collect()


def test_stream_equals_batch_over_several_files(spark, tmp_path, rows):
    src = f"file://{tmp_path}/in"
    parts = [[("k", "de", 1, 5), ("m", "de", 2, 1)], [("k", "de", 3, 9), ("k", "de", 4, 2)], [("m", "de", 5, None)]]
    schema = "source_key string, lang string, id long, revised_at int"
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        watch.latest_state(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/c", ["source_key", "lang"], ["revised_at", "id"], compact=2).awaitTermination()
    assert sinks.current(spark, f"file://{tmp_path}/t") and len(watch._deltas(spark, f"file://{tmp_path}/t")) == 1
    got = watch.state(spark, f"file://{tmp_path}/t", ["source_key", "lang"], ["revised_at", "id"])
    assert rows(got.select("source_key", "id")) == rows(latest(spark.read.parquet(src), ["source_key", "lang"], ["revised_at", "id"]).select("source_key", "id")) == [("k", 3), ("m", 2)]


def test_documents_stream_and_counts(spark, tmp_path):
    src = f"file://{tmp_path}/docs"
    spark.createDataFrame([("a.md", "# h\n\np")], "path string, text string").write.parquet(src)
    stream = spark.readStream.schema("path string, text string").parquet(src)
    watch.documents_to_segments(stream, "path", "text", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    rev = f"file://{tmp_path}/rev"
    spark.sql("select timestamp_ntz'2024-01-01 10:00:00' as revised_at, 'a' as author union all select null, 'b' union all select timestamp_ntz'2024-01-09 10:00:00', 'a'").write.parquet(rev)
    counts = watch.revision_counts(watch.revisions_stream(spark, rev, spark.read.parquet(rev).schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 1]


def test_old_versions_go_and_a_reader_always_finds_one(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    made = [sinks.write_version(spark.range(n + 1).toDF("i"), root) for n in range(4)]
    assert sinks.current(spark, root) == made[-1] and spark.read.parquet(made[-2]).count() == 3
    assert sorted(p.name for p in (tmp_path / "w").iterdir() if not p.name.startswith(".")) == ["CURRENT-3", "CURRENT-4", "v3", "v4"]


def test_projects(spark, tmp_path):
    from verbaloom.sources import files

    root = str(tmp_path / "p")
    assert sorted(files.scaffold(root)) == [".verbaloom.json", "docs/index.md", "locales/glossary.json"] and files.scaffold(root) == []
    (tmp_path / "p" / "docs" / "deep").mkdir()
    assert files.find_root(root + "/docs/deep") == str((tmp_path / "p").resolve()) and files.find_root(str(tmp_path)) == str(tmp_path.resolve())
    assert files.markdown(spark, root + "/docs").count() == 1 and files.json_at_branch(root, "main", "x.json") is None
    old = spark.createDataFrame([("a  b", "c")], "source string, target string")
    row = files.migrated(old).first()
    assert (row.lang, row.status, row.meta_json, row.embedding, len(row)) == ("de", "translated", "{}", None, 11) and files.migrated(files.migrated(old)).first() == row
