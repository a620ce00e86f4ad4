"""Every registered query against its SQL twin on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import compare
from tremor.plans import registry

SF = os.environ.get("TREMOR_TEST_SF", "/root/testdata/sf0.001")
registry.load_all()


@pytest.fixture(scope="module")
def results(request, spark):
    """Runs the selected queries a few at a time: on tables this small the
    time goes into planning, not into tasks."""
    names = [i.callspec.params["name"] for i in request.session.items if getattr(i, "callspec", None) and i.fspath == request.fspath]

    def one(name):
        # A connection each: a fatal engine error closes a whole database.
        # Internal faults of the SQL engine (not wrong rows) are tried again.
        for attempt in range(3):
            try:
                return compare.compare(spark, compare.connect(SF), name, registry.QUERIES[name], registry.ORACLES.get(name), SF)[0]
            except Exception as exc:  # noqa: BLE001 - reported by the query's own test
                if "INTERNAL Error" not in str(exc) or attempt == 2:
                    return f"ERROR {exc}"

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(names, pool.map(one, names)))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(results, name):
    assert results[name].startswith(("ok", "rows-only")), results[name]


def test_no_cross_join_or_local_checkpoint():
    import pathlib

    src = "\n".join(p.read_text() for p in pathlib.Path(registry.__file__).parents[1].rglob("*.py"))
    assert "crossJoin" not in src and "localCheckpoint" not in src
