"""All registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from runline.jobs import stage_one, stage_two


def queries() -> dict:
    return {**stage_one.QUERIES, **stage_two.QUERIES}


def oracle_sql() -> dict:
    return {**stage_one.ORACLE, **stage_two.ORACLE}
