"""Files in, tables out: Markdown trees, catalogues, manifests, memories, glossaries, gettext; and hashes of inputs.

A folder or file that isn't there gives an empty table of the right shape. Malformed JSON documents give no
rows (catalogues without ``entries`` raise, as they would be taken for empty ones).
"""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import text as T

SEGMENT = "struct<id:string,kind:string,source:string,target:string,frozen:boolean,fingerprint:string,status:string,meta:map<string,string>>"
NODE = "struct<id:string,kind:string,source:string,fingerprint:string>"
MEMORY = "struct<source:string,target:string,kind:string,status:string,last_segment_id:string,segment_id:string>"


def _exists(path: str) -> bool:
    return "://" in path or any(c in path for c in "*?[") or Path(path).exists()


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    if not _exists(path):
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def markdown(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "mdx")) -> DataFrame:
    """(path, text) of every document below ``root``; paths are relative to it."""
    base = "file:" + str(Path(root).resolve()) + "/" if "://" not in root else root.rstrip("/") + "/"
    found = _whole(spark, root, "*.{" + ",".join(extensions) + "}")
    return found.select(F.when(F.startswith("path", F.lit(base)), F.substring("path", len(base) + 1, 1 << 20)).otherwise(F.col("path")).alias("path"), "text")


def hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, hash) by content; a missing file has no row, so an anti join finds it."""
    if not _exists(root):
        return spark.createDataFrame([], "path string, hash string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select("path", F.sha2("content", 256).alias("hash"))


def catalogues(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_path, ord, segment columns) of catalogue documents."""
    docs = _whole(spark, path, "*.json").select("path", F.from_json("text", f"struct<source:string,entries:array<{SEGMENT}>>").alias("c"))
    checked = docs.withColumn("entries", F.when(F.col("c.entries").isNull(), F.raise_error(F.concat(F.lit("no 'entries' in "), F.col("path"))).cast(f"array<{SEGMENT}>")).otherwise(F.col("c.entries")))
    rows = checked.select(F.col("path").alias("file"), F.col("c.source").alias("doc_path"), F.posexplode("entries").alias("ord", "e"))
    return rows.select("file", "doc_path", "ord", "e.*")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_path, ord, id, kind, src_text, fingerprint)."""
    docs = _whole(spark, path, "*.json").select("path", F.from_json("text", f"struct<source:string,nodes:array<{NODE}>>").alias("m"))
    rows = docs.select(F.col("path").alias("file"), F.col("m.source").alias("doc_path"), F.posexplode("m.nodes").alias("ord", "n"))
    return rows.select("file", "doc_path", "ord", "n.id", "n.kind", F.col("n.source").alias("src_text"), "n.fingerprint")


def memory_json(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Entries of memories of the first version, a map by source key or a list, in the columns of the second."""
    docs = _whole(spark, path, "*.json").select("text")
    as_map = F.map_values(F.from_json("text", f"struct<entries:map<string,{MEMORY}>>")["entries"])
    as_list = F.from_json("text", f"struct<entries:array<{MEMORY}>>")["entries"]
    is_list = F.get_json_object("text", "$.entries").startswith("[")
    rows = docs.select(F.explode(F.when(is_list, as_list).otherwise(as_map)).alias("e")).filter("e.source <> '' and e.target <> ''")
    return rows.select(
        T.source_key(F.col("e.source")).alias("source_key"), "e.source", "e.target", F.lit(lang).alias("lang"), F.coalesce("e.kind", F.lit("")).alias("kind"),
        F.coalesce(F.nullif("e.last_segment_id", F.lit("")), "e.segment_id", F.lit("")).alias("segment_id"), F.coalesce("e.status", F.lit("translated")).alias("status"),
    )


def memory_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a memory kept in SQLite, read on the driver (one local file) in the columns it has."""
    import sqlite3

    columns = ["source_key", "source", "target", "lang", "kind", "segment_id", "status", "updated_at", "meta_json"]
    if not Path(path).exists():
        return spark.createDataFrame([], ", ".join(f"{c} {'double' if c == 'updated_at' else 'string'}" for c in columns))
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        have = {r[1] for r in con.execute("pragma table_info(tm_entries)")}
        rows = con.execute("select " + ", ".join(c if c in have else f"null as {c}" for c in columns) + " from tm_entries").fetchall()
    return spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c == 'updated_at' else 'string'}" for c in columns))


def migrated(memory: DataFrame) -> DataFrame:
    """A memory in all eleven columns of the second version: those that an older one lacks are added with their defaults."""
    defaults = {
        "source_key": T.source_key(F.col("source")), "source": F.lit(""), "target": F.lit(""), "lang": F.lit("de"), "kind": F.lit(""), "segment_id": F.lit(""), "status": F.lit("translated"),
        "updated_at": F.lit(None).cast("timestamp"), "meta_json": F.lit("{}"), "embedding": F.lit(None).cast("array<float>"), "embedding_backend": F.lit(None).cast("string"),
    }
    return memory.select(*[F.col(c) if c in memory.columns else d.alias(c) for c, d in defaults.items()])


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, note) of glossaries that are a list or have ``terms``; ``term`` stands for ``source``."""
    term = "array<struct<source:string,term:string,target:string,note:string>>"
    docs = _whole(spark, path, "*.json").select(F.trim("text").alias("text"))
    terms = F.when(F.startswith("text", F.lit("[")), F.from_json("text", term)).otherwise(F.from_json("text", f"struct<terms:{term}>")["terms"])
    rows = docs.select(F.explode(terms).alias("t")).select(F.coalesce(F.nullif("t.source", F.lit("")), "t.term").alias("source"), F.coalesce("t.target", F.lit("")).alias("target"), F.coalesce("t.note", F.lit("")).alias("note"))
    return rows.filter("source <> ''")


def gettext(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of gettext files, for exchange.po_entries."""
    return _whole(spark, path, "*.po")


def find_root(start: str, marker: str = ".verbaloom.json") -> str:
    """The nearest folder from ``start`` upwards that holds the marker; ``start`` itself if none does."""
    here = Path(start).resolve()
    return str(next((p for p in (here, *here.parents) if (p / marker).exists()), here))


def scaffold(root: str, marker: str = ".verbaloom.json", force: bool = False) -> list[str]:
    """Lay out a new project: folders, settings, a document and a glossary. What is there stays unless ``force``; the files written."""
    base, written = Path(root), []
    for folder in ("docs", "build", "locales/de", "locales/en"):
        (base / folder).mkdir(parents=True, exist_ok=True)
    first = {marker: json.dumps(config("")), "docs/index.md": "# Start\n\nFirst text.\n", "locales/glossary.json": json.dumps({"version": 1, "terms": []})}
    for name, text in first.items():
        if force or not (base / name).exists():
            (base / name).write_text(text, encoding="utf-8")
            written.append(name)
    return written


def config(path: str, defaults: dict | None = None) -> dict:
    """A flat JSON object over the defaults."""
    own = json.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else {}
    return {"source_dir": "docs", "build_dir": "build", "locales_dir": "locales", "default_lang": "de", "langs": ["de", "en"]} | (defaults or {}) | own


def changed_files(root: str, base: str = "origin/main", prefix: str = "docs/") -> list[str]:
    """Documents that differ from ``base`` in a git work tree: a short list on the driver, for a semi join."""
    run = subprocess.run(["git", "-C", root, "diff", "--name-only", f"{base}...HEAD"], capture_output=True, text=True, check=False)
    names = run.stdout.split("\n") if run.returncode == 0 else []
    return sorted(n for n in names if n.startswith(prefix) and n.endswith((".md", ".mdx")) and (Path(root) / n).exists())


def at_branch(root: str, branch: str, name: str) -> str | None:
    """A file's text on another branch."""
    run = subprocess.run(["git", "-C", root, "show", f"{branch}:{name}"], capture_output=True, text=True, check=False)
    return run.stdout if run.returncode == 0 else None


def json_at_branch(root: str, branch: str, name: str) -> object | None:
    """A JSON file as it is on another branch; None if it isn't there or isn't JSON."""
    text = at_branch(root, branch, name)
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None
