"""The registered queries against their SQL on the smallest tables (those of the engine)."""

import glob
import os

import duckdb
import pytest

from stratafold.plans import queries

SF = "/root/testdata/sf0.001"
SAMPLE = ["seq_events", "poisson_hyper", "gauss_blocks", "posterior_k", "map_segments", "bayes_curve_fixed", "predictive_poisson", "pooled_replicates", "brier_logscore", "gh_blocks", "optimal_partition_l2"]
SAMPLE += [
    "segment_events_poisson", "segment_users_irregular", "dp_diagnostics", "map_score_check", "ks_uniform", "laplace_blocks", "jj_blocks", "beta_obs_blocks", "pelt", "binary_segmentation",
    "pit_gauss", "pit_beta", "pit_binomial_bounds", "pit_negbin_bounds", "node_weights", "predictive_beta_obs", "predictive_logit", "window_scores", "policy_record",
    "replicate_means", "replicate_predictions", "replicate_score", "channel_score", "independent_score", "predict_bayes", "interval_units", "group_prediction",
]
SAMPLE += [
    "segment_half_hours", "mixture_m_step", "mixture_e_step", "overlapping_units", "exact_totals", "evidence_rollup", "bootstrap_ci", "prior_exchange", "span_prior_blocks", "span_prior_kernel", "stitched_fit",
    "stitched_posterior", "wbs", "permuted_accuracy", "beta_obs_kernel", "gh_kernel", "logistic_integrals", "certify_laplace", "group_classifier", "quantity_channels", "renewal_fit", "null_comparison", "prior_sensitivity",
    "prior_count", "log_ck_uniform", "special_functions",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    a = queries.QUERIES[name](spark, SF).toPandas()
    b = con.execute(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    key = [c for c in cols if a[c].dtype != float] or cols
    for x in (a, b):
        for c in cols:
            if x[c].dtype == object:
                x[c] = x[c].fillna("")
    a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype == float:
            assert ((a[c] - b[c]).abs() <= 2e-6 + 1e-9 * b[c].abs()).all(), c
        else:
            assert (a[c] == b[c]).all(), c


def test_oracles_have_queries():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
