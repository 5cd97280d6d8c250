"""Tables out: versioned tables with a pointer, one file by row, JSON lines of nested catalogues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers of a versioned table, in order."""
    fs, hadoop = _fs(spark, root)
    found = fs.globStatus(hadoop(f"{root}/CURRENT-*")) or []
    return sorted(int(f.getPath().getName().split("-")[1]) for f in found)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest version of a versioned table; None before the first."""
    have = _versions(spark, root)
    return f"{root}/v{have[-1]}" if have else None


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """Write a new version beside the old ones and then its pointer; the highest pointer counts, so a reader always finds one.

    Nothing that is being read is overwritten, so the new version may be computed from the current one. Only the last
    ``keep`` versions stay. A folder without a pointer, left by a job that failed, is written anew.
    """
    spark = df.sparkSession
    fs, hadoop = _fs(spark, root)
    have = _versions(spark, root)
    n = have[-1] + 1 if have else 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/v{n}")
    fs.create(hadoop(f"{root}/CURRENT-{n}"), False).close()
    for old in [*have, n][: -max(1, keep)]:
        fs.delete(hadoop(f"{root}/CURRENT-{old}"), False)
        fs.delete(hadoop(f"{root}/v{old}"), True)
    return f"{root}/v{n}"


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_texts(df: DataFrame, path: str, text: str, root: str) -> DataFrame:
    """Write each row's text to its own file below ``root``, a folder or an address that all executors reach; (path, bytes) of each.

    Lazy: the files are written when the result is read; a task that runs again writes the same. Paths that would leave the folder are refused.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), posixpath.abspath(root))
        for pdf in batches:
            sizes = []
            for p, t in zip(pdf.path, pdf.text, strict=True):
                to = posixpath.normpath(posixpath.join(base, p))
                if not to.startswith(base.rstrip("/") + "/"):
                    raise ValueError(f"outside the folder: {p}")
                files.create_dir(posixpath.dirname(to), recursive=True)
                data = (t or "").encode()
                with files.open_output_stream(to) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": pdf.path, "bytes": sizes})

    return df.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(put, "path string, bytes long")
