"""All registered queries of the core."""

from __future__ import annotations

from nebulith.plans import catalog, dealt, dealt_sql, reference_a, reference_b, reference_c, reference_d, reference_e, reference_f, reference_g, reference_h, reference_i, reference_j, reference_k  # noqa: F401  (the modules register their queries)


def queries() -> dict:
    return catalog.QUERIES | dealt.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog.SQL | dealt_sql.SQL
