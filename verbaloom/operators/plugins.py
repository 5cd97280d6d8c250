"""Hooks on tables, providers of translations and vectors."""

from __future__ import annotations

import importlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions import similarity as S
from verbaloom.functions import text as T
from verbaloom.operators.catalogue import needs_translation, neighbours

Transform = Callable[[DataFrame], DataFrame]
HOOKS = ("on_init", "pre_compile", "post_compile", "pre_render", "post_render", "pre_render_segment")


class Hooks:
    """Transformations by the name of the moment; each takes a table and returns one, or None to leave it."""

    def __init__(self) -> None:
        self._by: dict[str, list[Callable]] = defaultdict(list)
        self.failures: list[tuple[str, str]] = []

    def register(self, hook: str, fn: Callable) -> None:
        self._by[hook].append(fn)

    def apply(self, hook: str, df: DataFrame, **context) -> DataFrame:
        for fn in self._by[hook]:
            out = fn(df, **context)
            df = df if out is None else out
        return df

    def load(self, names: list[str]) -> Hooks:
        """Modules with ``register(hooks)`` or functions named like hooks; one that fails is noted and skipped."""
        for name in names:
            try:
                module = importlib.import_module(name)
            except Exception as e:
                self.failures.append((name, str(e)))
                continue
            if hasattr(module, "register"):
                module.register(self)
            for hook in HOOKS:
                if callable(getattr(module, hook, None)):
                    self.register(hook, getattr(module, hook))
        for fn in self._by["on_init"]:
            fn()
        return self


Provider = Callable[[list[dict], str], list[str]]


def mock(source: Column, lang: Column) -> Column:
    return F.concat(F.lit("["), lang, F.lit("] "), source)


NATIVE: dict[str, Callable[[Column, Column], Column]] = {"mock": mock, "identity": lambda source, lang: source}


def translate(catalogue: DataFrame, provider: str | Provider, keys: list[str], batch: int = 20) -> DataFrame:
    """(keys, id, target, status, provider) for segments without a target.

    A native provider is an expression. Any other is called with batches of items (id, kind, source and the
    sources before and after) in each partition, and must return as many texts as it got.
    """
    gaps = needs_translation(neighbours(catalogue, keys)).filter("source <> ''")
    if isinstance(provider, str):
        made = gaps.select(*keys, "id", NATIVE[provider](F.col("source"), F.col("lang")).alias("target"))
        return made.withColumns({"status": F.lit("needs_review"), "provider": F.lit(provider)})

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, group in pdf.groupby("lang", sort=False):
                for lo in range(0, len(group), batch):
                    part = group.iloc[lo : lo + batch]
                    out = provider(part[["id", "kind", "source", "prev_source", "next_source"]].to_dict("records"), lang)
                    if len(out) != len(part):
                        raise ValueError(f"expected {len(part)} translations, got {len(out)}")
                    yield part[[*keys, "id"]].assign(target=out)

    cols = list(dict.fromkeys([*keys, "id", "lang", "kind", "source", "prev_source", "next_source"]))
    schema = gaps.select(*keys, "id").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", target string"
    made = gaps.select(*cols).mapInPandas(call, schema)
    return made.withColumns({"status": F.lit("needs_review"), "provider": F.lit(getattr(provider, "__name__", "provider"))})


def payloads(catalogue: DataFrame, keys: list[str], batch: int = 20) -> DataFrame:
    """(keys, batch, payload): the JSON a translator is sent, ``batch`` segments at a time."""
    from pyspark.sql import Window

    gaps = needs_translation(neighbours(catalogue, keys)).filter("source <> ''")
    w = Window.partitionBy(*keys).orderBy("ord")
    numbered = gaps.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch).cast("int"))
    item = F.struct("ord", "id", "kind", "source", "prev_source", "next_source")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("ord"))
    return numbered.groupBy(*keys, "batch").agg(F.to_json(F.struct(listed.alias("items"))).alias("payload"))


VECTORS = {"hash": S.hashed_vectors}


def vectors(df: DataFrame, text: str, backend: str = "hash", strict: bool = False) -> DataFrame:
    """df with vector and backend; an unknown backend falls back to hashing unless strict."""
    if backend not in VECTORS and strict:
        raise KeyError(backend)
    name = backend if backend in VECTORS else "hash"
    return df.withColumns({"vector": VECTORS[name](T.normalised(F.col(text))), "backend": F.lit(name)})
