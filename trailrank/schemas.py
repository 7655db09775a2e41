"""Explicit schemas of the input files (Spark DDL)."""

INSTANCES = ("instance_id string, repo string, base_commit string, problem_statement string, patch string, "
             "test_patch string, FAIL_TO_PASS string, PASS_TO_PASS string")
FILES = "repo string, commit string, path string, text string"
TREE = "repo string, commit string, paths array<string>, truncated boolean"
COVERAGE_RAW = "instance_id string, files map<string, struct<executed_lines: array<int>>>"
COVERAGE_MAP = "instance_id string, files map<string, array<int>>"
VALUE_TRACE_RAW = "instance_id string, trace map<string, map<string, string>>"
LOCATIONS = ("instance_id string, found_files array<string>, found_related_locs array<array<string>>, "
             "found_edit_locs array<array<array<string>>>")
VOTE_CACHE = "instance_id string, votes map<string, double>"
SUBSETS = "subset string, instance_ids array<string>"
PROBE_ANSWERS = "key string, cat string, role string, arm string, ans string, vf boolean"
ARM_METRICS = ("instance_id string, repo string, n_gold_files int, tot_gold int, has_cov boolean, "
               "arms map<string, struct<R1: int, R3: int, R5: int, R10: int, recall: double, precision: double, f1: double, n_pred: int, hits: int>>")
RANKS = "instance_id string, ranks map<string, array<array<string>>>, gold_flat array<array<string>>"
SUBSTRATE = ("instance_id string, file string, region array<int>, n_region int, freq map<string, double>, counts map<string, int>, "
             "gold array<int>, file_lines int")
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"
