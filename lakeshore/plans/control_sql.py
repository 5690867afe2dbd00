"""The control sum as DuckDB SQL, written from its definition: per key, the
sum over the levels L of |1 - S(base) / S(L)|, where a missing or zero S(L)
adds nothing."""

from __future__ import annotations


def control_sum_ctes(table: str, where: str = "TRUE", keys: str = "dataset_checksum",
                     levels: tuple[int, ...] = (2, 4, 6), base: int = 0) -> dict[str, str]:
    """CTEs ``traded``, ``level_sums`` and ``sums`` (the result) over ``table``."""
    listed = ", ".join(f"({level})" for level in levels)
    return {
        "traded": f"""
SELECT {keys}, aggr_level, primary_value FROM {table}
WHERE ({where}) AND customs_code = 'C00' AND try_cast(mos_code AS BIGINT) = 0 AND try_cast(mot_code AS BIGINT) = 0
  AND partner2_code = 0 AND partner_code <> 0
""",
        "level_sums": f"""
SELECT {keys}, aggr_level, sum(primary_value) AS total FROM traded GROUP BY {keys}, aggr_level
""",
        "sums": f"""
SELECT {keys}, round(coalesce(gap, 0), 5) AS control_sum, row_count
FROM (SELECT {keys}, count(*) AS row_count FROM traded GROUP BY {keys})
LEFT JOIN (
  SELECT {keys}, sum(abs(1 - coalesce(b.total, 0) / l.total)) AS gap
  FROM level_sums l JOIN (VALUES {listed}) AS wanted(aggr_level) USING (aggr_level)
  LEFT JOIN (SELECT {keys}, total FROM level_sums WHERE aggr_level = {base}) b USING ({keys})
  WHERE l.total <> 0 GROUP BY {keys}) USING ({keys})
""",
    }
