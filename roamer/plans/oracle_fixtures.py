"""DuckDB definitions of the fixture views, for the oracle SQL.

Written independently of the Spark side from the formulas in FIXTURES.md.
Each entry is the body of a CTE; ``with_views`` prepends the needed ones.
"""

from __future__ import annotations

import re

_PLACES = """
  SELECT p.p_partkey AS k, p.p_name, p.p_type, p.p_size AS z, n.n_name, r.r_name
  FROM part p JOIN nation n ON n.n_nationkey = p.p_partkey % 25
  JOIN region r ON r.r_regionkey = n.n_regionkey
"""

_MONTH_JSON = " || ', ' || ".join(
    f"""'"{m}": {{"avg": ' || CAST((k*7 + 13*{m}*{m}) % 42 - 7 AS VARCHAR) || '}}'"""
    for m in range(1, 13)
)

_RATINGS = [("beaches", 3, 59), ("culture", 5, 61), ("nature", 7, 67),
            ("nightlife", 11, 71), ("cuisine", 13, 73), ("adventure", 17, 53),
            ("wellness", 19, 47), ("urban", 23, 43)]

VIEWS: dict[str, str] = {}

VIEWS["catalog_raw"] = f"""
  SELECT k AS item_id,
         ' ' || p_name || ' ' AS city_name,
         n_name AS country_name,
         CASE WHEN k % 97 = 0 THEN NULL ELSE r_name END AS continent,
         CASE WHEN k % 101 = 0 THEN NULL ELSE ((k*37) % 1400 - 700) / 10.0::DOUBLE END AS lat,
         CASE WHEN k % 101 = 0 THEN NULL ELSE ((k*53) % 3600 - 1800) / 10.0::DOUBLE END AS lng,
         CASE p_type WHEN 'ECONOMY' THEN 'Budget' WHEN 'STANDARD' THEN 'mid-range'
              WHEN 'MEDIUM' THEN 'mid range' WHEN 'PROMO' THEN ' LUXURY '
              WHEN 'LARGE' THEN 'luxury' ELSE 'unknown' END AS budget_level,
         CASE WHEN k % 89 = 0 THEN NULL WHEN k % 83 = 0 THEN '17.5'
              WHEN k % 79 = 0 THEN 'garbage'
              ELSE '{{' || {_MONTH_JSON} || '}}' END AS avg_temp_monthly,
         {", ".join(f"CASE WHEN k % {q} = 0 THEN NULL ELSE (z*{p} + k) % 6 END AS {n}" for n, p, q in _RATINGS)}
  FROM ({_PLACES}) pl
"""

VIEWS["curated"] = f"""
  SELECT k AS item_id, p_name AS city, n_name AS country, r_name AS region,
         ((k*37) % 1400 - 700) / 10.0::DOUBLE AS latitude,
         ((k*53) % 3600 - 1800) / 10.0::DOUBLE AS longitude,
         CAST(100 + k % 50 AS DOUBLE) AS cost_per_day_usd,
         CAST(k % 30 AS DOUBLE) AS avg_temp_c,
         CAST((z*3) % 11 AS DOUBLE) AS beach,
         CAST((z*5) % 11 AS DOUBLE) AS culture,
         CAST(k % 13 AS DOUBLE) AS nature
  FROM ({_PLACES}) pl WHERE k % 40 = 0
"""

_PROFILE_VALS = ", ".join(
    f"CAST((c*{j + 1} + {j}) % 11 AS INTEGER) AS {n}"
    for j, n in enumerate(["beach", "culture", "nature", "nightlife", "food",
                           "adventure", "relaxation", "safety", "popularity"])
)

VIEWS["profiles"] = f"""
  SELECT c AS profile_id,
         CAST(40 + (c*7) % 261 AS DOUBLE) AS budget_per_day_usd,
         CAST(c % 36 AS DOUBLE) AS preferred_temp_c,
         {_PROFILE_VALS},
         CASE WHEN c % 113 = 0 THEN 'NOWHERE' WHEN c % 3 = 0 THEN r_name ELSE 'anywhere' END AS region,
         CASE WHEN c % 7 = 0 THEN n_name ELSE 'anywhere' END AS country,
         DATE '2026-01-01' + CAST((c*11) % 700 AS INTEGER) AS start_date,
         DATE '2026-01-01' + CAST((c*11) % 700 + CASE WHEN c % 50 = 0 THEN 399 ELSE (c*5) % 21 END AS INTEGER) AS end_date,
         (['USD','EUR','GBP','ILS','CAD','AUD','JPY','CHF'])[CAST(c % 8 AS INTEGER) + 1] AS currency,
         CASE WHEN c % 5 <= 1 THEN 'Weighted scoring' WHEN c % 5 <= 3 THEN 'Cosine similarity'
              ELSE 'K-nearest neighbors' END AS method
  FROM (SELECT cu.c_custkey AS c, n.n_name, r.r_name FROM customer cu
        JOIN nation n ON n.n_nationkey = cu.c_nationkey
        JOIN region r ON r.r_regionkey = n.n_regionkey) x
"""

VIEWS["account_events"] = """
  SELECT event_id, ts, user_id,
         CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'save_preferences'
              WHEN 'click' THEN 'add_favorite' WHEN 'error' THEN 'remove_favorite'
              WHEN 'purchase' THEN 'save_search' END AS action,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id,
         value
  FROM events
"""

VIEWS["registrations"] = """
  SELECT c_custkey AS request_id,
         CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'no-at-sign.com'
              WHEN c_custkey % 17 = 0 THEN 'a@nodot'
              ELSE ' User' || CAST(c_custkey // 4 AS VARCHAR) || '@Example.COM ' END AS email,
         CASE WHEN c_custkey % 43 <> 0 THEN CAST(5 + c_custkey % 10 AS INTEGER) END AS password_length,
         CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN '   ' ELSE ' ' || c_name || ' ' END AS display_name
  FROM customer
"""

VIEWS["history"] = """
  SELECT o_orderkey AS id, o_custkey // 10 AS user_id, o_orderdate AS created_at,
         o_totalprice AS amount
  FROM orders
"""

VIEWS["users"] = """
  SELECT user_id, 'user' || user_id || '@example.com' AS email, 'Name ' || user_id AS display_name
  FROM (SELECT DISTINCT c_custkey // 10 AS user_id FROM customer) WHERE user_id % 13 <> 0
"""

VIEWS["accounts"] = "SELECT ' USER' || (c_custkey // 4) || '@example.com' AS email FROM customer WHERE c_custkey % 9 = 0"

VIEWS["deleted_users"] = "SELECT DISTINCT c_custkey // 10 AS user_id FROM customer WHERE (c_custkey // 10) % 17 = 0"

VIEWS["preference_saves"] = """
  SELECT o_orderkey AS save_id, o_custkey // 10 AS user_id, o_orderdate AS saved_at,
         '{"region": "' || (['ASIA', 'EUROPE', 'anywhere'])[CAST(o_orderkey % 3 AS INTEGER) + 1] || '", "budget_display": ' || (40 + o_orderkey % 261)
         || ', "preferred_temp": ' || (o_orderkey % 36) || ', "beach": ' || (o_orderkey % 11) || ', "culture": ' || (o_orderkey * 3 % 11) || '}' AS preferences_json
  FROM orders
"""

_NUMBERS = " || ', ' || ".join(f"""'"{n}": ' || {n}""" for n in ["culture", "nature", "nightlife", "food", "adventure", "relaxation", "safety", "popularity"])
VIEWS["saved_preferences"] = f"""
  SELECT c AS profile_id,
         '{{"region": "' || region || '", "country": "' || country || '"'
         || CASE WHEN c % 59 = 0 THEN '' ELSE ', "start_date": ' || CASE WHEN c % 23 = 0 THEN '"soon"' WHEN c % 41 = 0 THEN '"2030-01-01"' WHEN c % 53 = 0 THEN 'null' ELSE '"' || start_date || '"' END END
         || CASE WHEN c % 61 = 0 THEN '' ELSE ', "end_date": ' || CASE WHEN c % 31 = 0 THEN '"2026-13-45"' WHEN c % 43 = 0 THEN '"2031-01-01"' WHEN c % 47 = 0 THEN '"2026-01-01"' ELSE '"' || end_date || '"' END END
         || ', "currency": "' || CASE WHEN c % 19 = 0 THEN 'XXX' ELSE currency END || '"'
         || CASE WHEN c % 29 = 0 THEN '' ELSE ', "budget_display": ' || (c * 97 % 60000) END
         || ', "method_label": "' || (['Balanced match', 'Similar travel profile', 'Closest destination matches', 'Unknown'])[CAST(c % 4 AS INTEGER) + 1] || '"'
         || CASE WHEN c % 11 = 5 THEN '' ELSE ', "preferred_temp": ' || CAST(preferred_temp_c AS INTEGER) END
         || CASE WHEN c % 7 = 3 THEN '' ELSE ', "beach": ' || beach END || ', ' || {_NUMBERS} || '}}' AS preferences_json
  FROM (SELECT profile_id AS c, * FROM profiles)
"""

VIEWS["itineraries"] = """
  SELECT o_orderkey AS id, o_custkey // 10 AS user_id, 'City ' || (o_orderkey % 64) AS city, 'Country ' || (o_orderkey % 25) AS country,
         CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS end_date, o_orderdate AS created_at
  FROM orders WHERE o_orderkey % 3 = 0
"""

VIEWS["delete_requests"] = """
  SELECT o_orderkey AS id, o_custkey // 10 + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS user_id FROM orders WHERE o_orderkey % 5 = 0
"""

VIEWS["quotes"] = """
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of, o_orderkey AS quote_id,
         (['USD','EUR','GBP','ILS','CAD','AUD','JPY','CHF'])[CAST(o_orderkey % 8 AS INTEGER) + 1] AS code,
         CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE format('{:.2f}', (50 + o_orderkey % 300) / 100.0) END AS rate
  FROM orders
"""

VIEWS["daily_weather"] = """
  SELECT user_id AS place_id, CAST(ts AS DATE) AS day, max(value) AS high_c,
         min(value) AS low_c, round_even(sum(value) * 100, 0) / 100 AS precipitation_mm
  FROM events GROUP BY 1, 2
"""

VIEWS["image_candidates"] = """
  SELECT s.s_suppkey AS place_id, pr.priority,
         CASE WHEN (s.s_suppkey + pr.priority) % 3 = 0 THEN NULL
              ELSE 'http://img.example/' || CAST(s.s_suppkey AS VARCHAR) || '/' || CAST(pr.priority AS VARCHAR) END AS url,
         'place ' || s.s_name AS title
  FROM supplier s CROSS JOIN (SELECT unnest(range(1, 6)) AS priority) pr
  WHERE s.s_suppkey % 10 <> 9
"""


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with CTEs for every fixture view (and extra CTE) it names."""
    defs = dict(VIEWS)
    if extra:
        defs.update(extra)
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in defs.items():
            if name in needed:
                continue
            if re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in needed)
    return f"WITH {ctes}\n{sql}"
