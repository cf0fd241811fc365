"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from viewframe.plans import registry, registry_changes  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        out.execute(f"create view {Path(f).stem} as select * from '{SF}/{f}'")
    return out


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted(columns), sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.SQL:
        result = con.execute(registry.SQL[name])
        assert ours == canonical([d[0] for d in result.description], result.fetchall())
    else:
        assert ours[1]


def test_entry_without_the_subpackage(monkeypatch):
    """The entry module imports and registers the rest if llm is not there."""
    import builtins
    import importlib.util

    real = builtins.__import__

    def no_llm(name, *args, **kwargs):
        if "llm" in name or name == "corpus_pipeline" or "llm" in (args[2] or () if len(args) > 2 else ()):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    spec = importlib.util.spec_from_file_location("entry_alone", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert "fold" in module.queries() and not any(n.startswith("op") and n[2].isdigit() for n in module.queries())
    assert "fold" in module.oracle_sql()
