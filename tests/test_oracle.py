"""Every registered query with SQL gives the same values as DuckDB at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, duck

# a cross-section; check_oracle.py runs all of them
NAMES = [
    "s1_csv_scan", "p8_clean_values", "p15_quantile_bins", "u5_cross_table", "a1_overview_with_gaps", "a9_mad_outliers", "t1_associations", "t8_kurtosis_test",
    "w1_running_total", "w4_average_rank", "c2_histogram_by_group", "c3_density", "c5_box_summary", "f9_robust", "f12_one_hot", "v2_stratified_folds", "v4_bootstrap_weights",
    "g5_scores_macro", "g3_scores_weighted", "e4_roc_auc_multiclass", "e9_ks_statistic", "t22_corrected_t_test", "j3_knn_join", "j4_radius_counts", "n1_cluster_scores",
    "n2_silhouette_pairwise", "n3_agreement", "o1_hbos", "o2_ecod", "o6_lof", "o7_cblof_given_centres", "xp5_beeswarm", "h1_decompose_weekly", "z3_windowed_profile_stream",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, folder, name):
    assert compare(queries()[name](spark, folder), duck(folder), oracle_sql()[name]) is None


def test_registry_is_consistent(spark):
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 180
    assert entry(spark).count() == 12
