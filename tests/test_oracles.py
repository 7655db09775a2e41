"""Queries against their reference SQL at the smallest scale; ``tools/check.py`` runs all of them."""
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_arm_report", "a5_read_coverage_json", "a13_cache_precedence", "b1_diff_to_edit_lines", "b10_parse_paths", "b11_def_use", "b14_test_evidence", "c2_assign_quadrant",
         "c6_patch_kind", "d1_path_suffix_join", "d5_frontier_sweep", "d6_asof_last_def", "d13_value_context", "e4_score_sweep", "e6_rank_functions", "e7_rank_files",
         "e9_rrf_fuse", "e11_rank_coverage_tier", "e14_ochiai_per_test", "f1_dataflow_slice", "f7_backward_slice", "g5_loose_metrics", "g18_sweep_curve_window",
         "i2_pool_intersect", "j2_paired_bootstrap", "j7_cluster_net_sign"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF, con).startswith("ok")


def test_every_query_has_a_reference():
    from trailrank.plans.registry import ORACLES, QUERIES
    assert set(QUERIES) == set(ORACLES) and set(entry.queries()) >= set(entry.oracle_sql()) >= set(ORACLES)
