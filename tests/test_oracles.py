"""Every SQL-expressible query against its DuckDB oracle on the smallest
driver tables (the driver repeats this at sf0.01), and partition-count
independence of the non-model operators."""
import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tools.check_oracles import TABLES, norm

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    s = entry.queries()[name](spark, SF_SMALL).toPandas()
    o = con.sql(ORACLES[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert norm(s).equals(norm(o))


@pytest.mark.parametrize("name", ["stratified_folds", "standardize_by_fold", "permutation_importance_rule",
                                  "knn_cv_manhattan", "fold_summary", "modal_params"])
def test_same_result_with_1_4_16_partitions(spark, name):
    q = entry.queries()[name]
    outs = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        outs.append(norm(q(spark, SF_SMALL).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert outs[0].equals(outs[1]) and outs[0].equals(outs[2])


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and set(df.columns) >= {"fold", "accuracy", "macro_f1"}
