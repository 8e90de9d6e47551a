"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, langid, licenses, media, mixing, nearest, neardup, packing, pii, resampling, tokenfile, toxicity, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_token_files": tokenfile.op2_token_files,
    "op3_find_personal_data": pii.op3_find_personal_data,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": langid.op5_language_id,
    "op6_media_columns": media.op6_media_columns,
    "op7_pack_documents": packing.op7_pack_documents,
    "op8_nearest_vectors": nearest.op8_nearest_vectors,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_warc_bundles": warc.op11_warc_bundles,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_align_tokens": alignment.op13_align_tokens,
}
ORACLE_SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_warc_bundles": warc.OP11_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
}
