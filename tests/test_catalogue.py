"""Every query with SQL agrees with it on the smallest tables; every other one runs and keeps its columns."""

import os

import pytest

from lodestrata.plans import change_catalogue, evidence_catalogue, fact_catalogue, graph_catalogue, ledger_catalogue, nested_records, reader_catalogue, review_catalogue, source_catalogue
from tests.oracle import connection, same

FOLDER = "/root/testdata/sf0.001"
MODULES = (nested_records, change_catalogue, fact_catalogue, evidence_catalogue, graph_catalogue, ledger_catalogue, source_catalogue, review_catalogue, reader_catalogue)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__.rpartition(".")[2])
def test_agrees_with_sql(spark, con, module):
    sql, wrong = module.oracle_sql(), {}
    for name, query in module.queries().items():
        if name in sql:
            n, why = same(spark, con, FOLDER, query, sql[name])
            if why:
                wrong[name] = why
        else:
            assert query(spark, FOLDER).columns
    assert not wrong


def test_each_query_is_in_one_module():
    names = [n for m in MODULES for n in m.queries()]
    assert len(names) == len(set(names))
    assert all(set(m.oracle_sql()) <= set(m.queries()) for m in MODULES)


def test_whole_texts_and_all_paths_come_back_from_quoting(spark):
    rows = fact_catalogue.queries()["git_path_quoting"](spark, FOLDER).collect()
    plain = {("documents", r.doc_id): r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r.text is not None}
    plain |= {("manifest_entry", r.entry_id): r.path for r in spark.read.parquet(f"{FOLDER}/manifest_entry.parquet").collect()}
    assert {(r.origin, r.row_key): r.back for r in rows} == plain and len(rows) == len(plain) and max(len(x) for x in plain.values() if x) > 60


def test_root_covers_the_edges_of_a_generation(spark):
    assert source_catalogue.queries()["generation_root"](spark, FOLDER).first().rows == graph_catalogue.edges(spark, FOLDER).count()
