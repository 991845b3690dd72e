import pytest

import __spark_entry__ as entry

NAMES = [
    "relation_mining_contracted", "serial_context_mining", "switch_context_mining", "switch_neighbor_support", "switch_role_inference", "equipment_roots_ordered",
    "engineering_rule_evidence", "segment_dedupe_first_wins", "segment_pair_events", "conflict_merge_priority", "terminal_selection", "node_edges", "active_event_semijoin",
    "shape_cluster_components", "local_windows_topn", "greedy_disjoint_selection", "coincident_leader_cluster", "bus_growth_islands", "engineering_clusters", "pca_align",
    "chamfer_topk", "family_margin", "group_winner", "interval_union_coverage", "multiset_jaccard", "template_version_numbering", "symbol_id_split", "attribute_priority_coalesce",
    "nearest_text_prior", "path_prefix_descendants",
]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(same_rows, name):
    same_rows(name)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
