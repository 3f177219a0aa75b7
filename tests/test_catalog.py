"""Catalogue queries against DuckDB at the smallest scale; NEWSGAUGE_ALL=1 runs every one."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
CORE = """mart_group_coverage mart_group_daily mart_event_overview mart_group_resonance mart_coverage_gaps mart_week_events mart_survey_weeks mart_theme_week_attention
mart_theme_group_coverage mart_coverage_matrix mart_event_card mart_week_list join_range_window agg_median_mean src_corpus_union src_html_posts src_manifest_rows
txt_tokens txt_term_scores txt_group_terms prj_footer_strip prj_clean_text vec_max_probe vec_fragment_pool rel_best_cut rel_sample_cut rel_global_cut_loo
rel_acceptance_gates rel_stop_rule frm_actor_metrics frm_chi2 frm_holm frm_cast_matrix frm_js_divergence frm_within_event txt_provenance txt_medoid_jaccard dq_nonstandard_warn
dq_unique sink_partitioned_detail src_incremental_append sink_manifest sink_publish_marts win_percent_rank frm_blame_remedy frm_narrative_share_ci frm_cluster_medoid frm_dimensions vec_multi_event vec_top_k""".split()
NAMES = sorted(E.queries()) if os.environ.get("NEWSGAUGE_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    result, _ = compare(spark, con, FOLDER, name, E.queries()[name], E.oracle_sql().get(name))
    assert result.startswith(("ok", "rows-only")), result


def test_every_query_is_named_once_and_checked():
    own = set(E.CATALOG)
    assert len(own) == 250
    assert own <= set(E.oracle_sql())
