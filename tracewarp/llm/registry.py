"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import clustering, embedding_dedup, hmm_scoring, license_scan, line_dedup, media_columns, mixing, packing, pii, quality_classifier, simhash_dedup, source_divergence, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_hmm_scoring": hmm_scoring.op2_hmm_scoring,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_media_columns": media_columns.op7_media_columns,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_pii": pii.op10_pii,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_warc": warc.op12_warc,
    "op13_centroid_clustering": clustering.op13_centroid_clustering,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op8_embedding_dedup": embedding_dedup.ORACLE,
    "op11_source_divergence": source_divergence.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_centroid_clustering": clustering.ORACLE,
}
