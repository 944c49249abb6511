"""Registered queries of the reference's operators run and give rows; where SQL has the
answer, it is compared.  All of them with KESTREL_ALL_QUERIES=1 (about half an hour);
otherwise those without SQL that take a few seconds, as ``tools/check_oracle.py`` runs all."""

import os

import pytest

from kestrel.plans.catalog import ORACLE, QUERIES
from tests.conftest import SF001
from tests.test_entry import FAST
from tools.check_oracle import compare, duck

QUICK = ["T10_anova_or_kruskal_decision", "T10_posthoc_of_decision", "F5_rfe_ols_ranks", "M9_iterative_impute",
         "M9_iterative_impute_one_gap", "R2_components_two_features", "V3_ridge_cv_rmse_one_feature", "V11_qq_line"]
NAMES = sorted(set(QUERIES) - set(FAST)) if os.environ.get("KESTREL_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    from __spark_entry__ import queries
    df = queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        res = con.execute(ORACLE[name])
        msg = compare(rows, df.columns, res.fetchall(), [c[0] for c in res.description])
        assert msg is None, msg
    else:
        assert rows
