"""PySpark jobs for process monitoring, document retrieval and training-data preparation.

The public functions, by module; each is imported when it is first asked for, as ``plumbline.<name>``.
"""

from importlib import import_module

PUBLIC = {
    "sources.readings": "read_readings write_readings read_days",
    "sources.files": "list_documents parse_text read_documents read_knowledge read_model write_model write_index read_index append_index index_folder",
    "operators.readings": "time_range_filter project_columns format_time recent_range range_stats preview dataset_summary range_join stats_by_range",
    "operators.monitor": "validate_features score flag_anomalies t2_contributions spe_contributions top_features explain first_anomaly analyze_ranges control_chart_series",
    "operators.moments": "cells_of range_moments stats_by_cells monitor_by_cells",
    "operators.chunks": "chunk_fixed chunk_semantic chunk_documents assign_chunk_index processing_stats processing_totals",
    "operators.tfidf": "fit_vocabulary heavy_terms build_index append_texts embed index_stats sample_chunks",
    "operators.search": "blank_query_guard search_cosine search_tfidf_l2 search_by_source search_l2 search_dense_cosine attach_metadata pairwise_cosine similarity_ratio",
    "operators.knowledge": "kb_documents build_kb_index lookup_features explain_features solutions_by_priority solutions_by_keyword concept_by_term kb_stats search_concepts find_solutions explain_with_solutions related_features search_knowledge recommend",
    "functions.text": "tokenize ngrams split_sentences text_profile",
    "plans.fit": "fit_model",
    "plans.report": "text_report envelope",
    "streaming.monitor": "monitor_stream",
    "streaming.folder": "ingest_folder read_growing",
    "streaming.ranges": "watch_ranges replay",
}
_MODULES = {name: module for module, names in PUBLIC.items() for name in names.split()}
__all__ = sorted(_MODULES)


def __getattr__(name: str):
    if name not in _MODULES:
        raise AttributeError(name)
    return getattr(import_module(f"plumbline.{_MODULES[name]}"), name)
