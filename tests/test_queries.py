"""Queries against their SQL on the smallest tables: a part by default, all with ARBORIX_ALL=1."""

import os

import pytest

from arborix.plans.registry import ORACLES, QUERIES
from tests.compare import same

CHOSEN = """pf2_synapse_id pf4_no_self_contacts pf10_infinite_to_null pf16_mixed_by_correctness pf19_middle_share j1_label_join j5_composite_key j7_reverse_edges
j8_either_end j13_nearest_node j14_radius_nearest j16_cluster_pairs j18_threshold_sweep j19_nearest_value a2_group_summary a4_pivot_types a14_correlations a19_data_quality
w1_trailing_mean w2_centred_band w5_tied_ranks se3_complement b1_equal_width b4_histogram d2_segregation_index d3_master_table d6_degrees d8_connections d10_reciprocal_pairs
d11_reciprocity_fraction d14_side_occurrence d20_dominance d24_mixed_sweep d31_side_pairs st1_chi_square st4_levene st6_dunn st12_mixed_anova st14_nb_cells
m3_linear_regression m6_balanced_classes m7_stable_split m12_samples_per_class t2_heal t3_reroot t4_subtree_totals t7_labelled_contacts t9_fragments t12_path_lengths t13_reciprocal_distance
t17_filopodia_first t18_no_pre_below t20_issues w3_ecdf a12_quantiles d24b_correctness_sweep st5_kruskal st14b_nb_contrasts src1_csv_facts src4_columnar_scan src9_new_batches snk1_bucketed_table""".split()


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ARBORIX_ALL") else CHOSEN)
def test_against_sql(spark, small, name):
    same(QUERIES[name](spark, small), small, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
