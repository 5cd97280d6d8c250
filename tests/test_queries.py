"""Every core query against DuckDB's SQL on the smallest tables, and rules on the code."""

import math
import os
import re
from collections import Counter
from pathlib import Path

import pytest

from verbaloom.plans.catalogue import QUERIES, SQL

BASE = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool | int | str):
        return x
    return round(float(x), 6) if isinstance(x, float) or hasattr(x, "is_finite") else str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(BASE).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    cols = sorted(df.columns)
    got = [tuple(cell(r[c]) for c in cols) for r in df.collect()]
    if name not in SQL:
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = [tuple(cell(r[names.index(c)]) for c in cols) for r in result.fetchall()]
    assert Counter(got) == Counter(want)


def test_the_core_does_not_import_the_llm_folder():
    for p in ROOT.glob("verbaloom/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"verbaloom(?:\.| import )llm", p.read_text()), p


def test_no_local_checkpoints_or_cross_joins():
    for p in ROOT.glob("verbaloom/**/*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, p
