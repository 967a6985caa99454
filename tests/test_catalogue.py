"""Every query of the catalogue runs; those with a SQL twin give the same rows."""

import importlib.util
import sys

import pytest

from adjudica.plans.catalogue import ORACLES, QUERIES

from .oracle import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("hidden", [("corpus_pipeline",), ("adjudica.llm",), ("corpus_pipeline", "adjudica.llm")])
def test_entry_works_without_the_llm_subpackage(monkeypatch, hidden):
    import __spark_entry__ as engine

    assert set(ORACLES) <= set(engine.oracle_sql()) and set(QUERIES) <= set(engine.queries())
    for name in hidden:  # an import of it fails as if its folder were gone
        monkeypatch.setitem(sys.modules, name, None)
    spec = importlib.util.spec_from_file_location("entry_alone", engine.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(ORACLES)
