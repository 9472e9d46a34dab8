"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import ann, gif_media, license_scan, minhash_dedup, mixing, piece_sampling, pii, token_count, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_token_count": token_count.op2_token_count,
        "op3_piece_sampling": piece_sampling.op3_piece_sampling,
        "op4_media_gif": gif_media.op4_media_gif,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_near_dedup": minhash_dedup.op6_near_dedup,
        "op7_nearest": ann.op7_nearest,
        "op8_mixing": mixing.op8_mixing,
        "op9_pii": pii.op9_pii,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.SQL,
        "op5_url_filter": url_filter.SQL,
        "op8_mixing": mixing.SQL,
        "op9_pii": pii.SQL,
    }
