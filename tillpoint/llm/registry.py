"""The queries of the training-data operators."""

from __future__ import annotations

from tillpoint.llm import (
    chat,
    decontamination,
    fingerprints,
    hard_negatives,
    html_extraction,
    language_id,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    periodic_runs,
    personal_data,
    sharding,
)

_MODULES = [packing, fingerprints, near_dedup, html_extraction, line_dedup, chat, personal_data, language_id,
            decontamination, sharding, hard_negatives, license_scan, periodic_runs]


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
