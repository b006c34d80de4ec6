"""Every registered query beside its SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from srclens.session import new_path
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF).count() > 0
    else:
        assert difference(spark, con, queries()[name], sql, SF) is None


def test_entry(spark):
    assert entry(spark).count() == 9


def test_scanned_corpus_writes_its_files_in_many_tasks(spark, monkeypatch):
    from srclens.plans import queries as Q

    folders = []

    def remembered(session, name):
        folders.append(new_path(session, name))
        return folders[-1]

    monkeypatch.setattr(Q, "new_path", remembered)
    assert Q.QUERIES["scanned_corpus"](spark, "/root/testdata/sf0.01").count() > 0
    names = [p.name for p in Path(folders[0]).rglob("part-*.txt")]
    suppliers = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    assert len(names) == suppliers
    # the narrow table is one block, but no task writes most of the files
    assert max(Counter(n.split("-")[1] for n in names).values()) < suppliers / 2
