"""Driver contract smoke tests and an oracle subset at sf0.001."""

import pytest

from tests.conftest import SF001


def test_entry_runs(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert len(rows) > 0
    assert set(entry(spark).columns) == {"brand", "n", "mean", "median", "std"}


def test_every_query_has_a_name_prefix():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


FAST = ["A9_group_summary_top10", "A1_na_counts", "A5_describe_numeric", "A20_pearson_matrix",
        "D3_keep_first_per_key", "M1_inject_exact", "M12_split_exact", "T8_T9_kruskal_stat",
        "T12_mann_whitney_U_stat", "V7_roc_auc_rank_sum", "V8_average_precision_stepwise",
        "L2_ridge_two_features", "M8_knn_impute"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_subset(spark, name):
    import duckdb
    from __spark_entry__ import oracle_sql, queries
    from tools.check_oracle import TABLES, compare
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = queries()[name](spark, SF001)
    res = con.execute(oracle_sql()[name])
    msg = compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description])
    assert msg is None, msg
