"""Driver contract and a slice of the queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows
from locusframe.plans import registry
from locusframe.plans.views import TABLES

SF = "/root/testdata/sf0.001"
SLICE = [
    "agg_site_stats", "agg_contribution", "agg_compare_all_samples", "jn_count_overlaps", "win_merge_intervals",
    "win_threshold_regions", "agg_evenness", "flow_qtl_candidates", "agg_enrich_lists", "agg_gene_mutants",
    "agg_hit_summary", "scl_centre_probe", "flow_library_report", "src_vcf_calls", "str_site_stats",
]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql_but_the_iterative_one():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"re_marker_set"}
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SLICE)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
