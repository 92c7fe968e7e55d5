import pytest

from tests.helpers import SMALL, database, same
from veinwork.plans.registry import flagship, oracle_sql, queries

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    same(queries()[name](spark, SMALL), con, oracle_sql()[name])


def test_flagship_has_rows(spark):
    assert flagship(spark, SMALL).count() > 0


def test_entry_without_the_optional_part(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def absent(name, *args, **kwargs):
        if name.startswith("veinwork.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", absent)
    assert set(entry.queries()) == set(NAMES)
