"""Registered queries against their SQL. Set ORACLE=full for every query; by default one slice per family."""

import os

import pytest
from compare import SMALL, check, connect

import __spark_entry__ as entry
from strandframe.operators import ordered

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLICE = [
    "cpm", "size_factors", "differential_expression", "translate_frames", "codon_usage", "trim_report", "open_reading_frames", "digest_linear",
    "t_cell_epitopes", "variant_summary", "hardy_weinberg", "tajimas_d", "beta_diversity", "kaplan_meier", "over_representation", "enrichment_score",
    "connected_components", "map_reads", "kmer_similarity", "column_conservation", "marker_genes", "stream_run_log_windows", "backbone_dihedrals",
]
# Whole positions of the small tables fit one tile, so these run again with tiles of 256 to cross many edges.
TILED = [
    "depth_runs", "smoothed_depth", "peaks", "structural_variants", "copy_number_vs_median", "interval_overlap_counts", "interval_mean_coverage",
    "nearest_feature", "lead_snps", "trace_peaks", "synteny_score", "interval_summary",
]
NAMES = [n for n in QUERIES if n in SQL] if os.environ.get("ORACLE") == "full" else SLICE


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def agree(spark, duck, name):
    note, _, _, _ = check(spark, duck, SMALL, name, QUERIES[name], SQL[name])
    assert note.startswith("ok"), f"{name}: {note}"


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    agree(spark, duck, name)


@pytest.mark.parametrize("name", TILED)
def test_query_over_many_tiles(spark, duck, name, monkeypatch):
    monkeypatch.setattr(ordered, "POSITION_TILE", 256)
    agree(spark, duck, name)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    out = entry.entry(spark)
    assert out.columns == ["feature", "sample", "count", "cpm"] and out.count() == 20
