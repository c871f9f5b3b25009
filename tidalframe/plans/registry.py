"""The reference-derived and baseline queries, each beside its DuckDB oracle."""

from __future__ import annotations

from . import adaptive, baseline, coding, control, framing, levels, ordered, records, spectral


def _all() -> dict:
    return {**spectral.QUERIES, **ordered.QUERIES, **adaptive.QUERIES, **control.QUERIES, **coding.QUERIES, **levels.QUERIES, **records.QUERIES, **framing.QUERIES, **baseline.QUERIES}


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
