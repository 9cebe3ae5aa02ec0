"""DuckDB text of the fixture views, shared by every comparison query."""

from __future__ import annotations

from marketladder.plans.fixtures import CURRENCIES, RATES

CURRENCY_LIST = "[" + ",".join(f"'{c}'" for c in CURRENCIES) + "]"
RATE_ROWS = ", ".join(f"('{c}', {units!r}::DOUBLE)" for c, units in RATES.items())

OBS = f"""
fx(currency, units) AS (VALUES {RATE_ROWS}),
market AS (
  SELECT 'm' || lpad(n_nationkey::VARCHAR, 2, '0') AS region, n_nationkey::BIGINT AS ord,
         {CURRENCY_LIST}[(n_nationkey % 18) + 1] AS currency, n_name AS market_name
  FROM nation),
anchor AS (SELECT 'm' || lpad(min(s_nationkey)::VARCHAR, 2, '0') AS region FROM supplier),
raw0 AS (
  SELECT l.*, s_nationkey::BIGINT AS nk, p_type, p_size,
         'm' || lpad(s_nationkey::VARCHAR, 2, '0') AS region,
         l_shipdate >= TIMESTAMP '1998-07-01' AS is_after,
         {CURRENCY_LIST}[(s_nationkey % 18) + 1] AS currency,
         l_quantity::INTEGER AS tier
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
raw1 AS (
  SELECT *, region = (SELECT region FROM anchor) AS anchor,
         ((l_partkey % 20) * 31 + nk * 7 + CASE WHEN is_after THEN 3 ELSE 0 END) % 10 AS h
  FROM raw0),
raw2 AS (
  SELECT *, CASE WHEN anchor THEN 'ok-structured' WHEN h = 0 THEN 'error:HTTP 404'
              WHEN h = 1 THEN 'iap-section-missing' WHEN h = 2 THEN 'error:HTTP 503'
              WHEN h <= 4 THEN 'ok-textPairs' ELSE 'ok-structured' END AS status
  FROM raw1),
raw AS (
  SELECT CASE WHEN is_after THEN 'after' ELSE 'before' END AS snap,
    (100000 + l_partkey % 20)::VARCHAR AS app_id, region, nk AS ord, currency, anchor, status,
    CASE WHEN NOT anchor AND h = 4 THEN 'error:HTTP 429' END AS identity_status,
    (l_orderkey * 8 + l_linenumber) * 4194304
      + (l_partkey * 7919 + l_suppkey * 104729 + l_quantity::BIGINT * 31) % 4194304 AS pos,
    trim(p_type) || CASE p_size % 4 WHEN 0 THEN ' Monthly' WHEN 1 THEN ' Annual' WHEN 2 THEN ' Credits' ELSE '' END AS name,
    CASE WHEN currency = 'EUR' THEN '€' || (tier - 1) || ',99'
         WHEN currency = 'TRY' THEN '₺' || (tier - 1) || ',99'
         WHEN currency = 'BRL' THEN 'R$' || (tier - 1) || ',99'
         WHEN currency = 'VND' THEN tier || '.000đ'
         WHEN currency = 'JPY' THEN '¥' || tier || ',000'
         WHEN currency = 'IDR' AND tier % 2 = 0 THEN 'Rp ' || tier || 'ribu'
         WHEN currency = 'IDR' THEN 'Rp ' || tier || '.000'
         WHEN currency = 'INR' AND tier % 10 = 0 THEN 'Rs.' || (tier - 1) || '.99'
         WHEN currency = 'INR' THEN '₹' || (tier - 1) || '.99'
         ELSE '$' || (tier - 1) || '.99' END AS price,
    CASE WHEN status = 'ok-structured' THEN (600000 + l_partkey)::VARCHAR END AS product_id,
    CASE WHEN status = 'ok-structured' AND l_partkey % 13 = 0 THEN 'Offer ' || (nk % 2) END AS offer_name,
    CASE WHEN status = 'ok-structured' THEN CASE p_size % 4 WHEN 0 THEN 'P1M' WHEN 1 THEN 'P1Y' END END AS billing_period,
    CASE WHEN status = 'ok-structured' THEN 'F' || (l_partkey % 7
       + CASE WHEN l_partkey % 11 = 0 AND nk % 2 = 1 THEN 1 ELSE 0 END) END AS family_id
  FROM raw2),
obs AS (SELECT * FROM raw WHERE status LIKE 'ok-%'),
cell AS (
  SELECT snap, app_id, region, ord, status, identity_status,
         count(*) FILTER (WHERE status LIKE 'ok-%') AS item_count
  FROM raw GROUP BY ALL)
"""

REQ = """
req AS (
  SELECT user_id AS key, ts, event_id,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'manual' WHEN 'purchase' THEN 'hot'
                    WHEN 'signup' THEN 'put' ELSE 'error' END AS mode, value
  FROM events)
"""

CATALOG = """
catalog AS (
  SELECT (100000 + p_partkey)::VARCHAR AS app_id, p_name AS app_name, p_brand AS developer, p_type AS category,
         (p_partkey * 7) % 1000003 AS place
  FROM part)
"""


def amount(text: str, currency: str | None) -> str:
    """Localized amount in DuckDB SQL (currency None: the form for ratios)."""
    kept = f"regexp_replace(coalesce({text}, ''), '[^0-9.,]', '', 'g')"
    comma = f"(length({kept}) - length(split_part({kept}, ',', -1)))"
    dot = f"(length({kept}) - length(split_part({kept}, '.', -1)))"
    places = f"length(split_part({kept}, ',', -1))"
    dot_places = f"length(split_part({kept}, '.', -1))"

    def number(value: str) -> str:
        return f"CASE WHEN {value} = '' THEN 0.0::DOUBLE ELSE TRY_CAST({value} AS DOUBLE) END"

    plain = f"""CASE
      WHEN {comma} > 0 AND {dot} > 0 AND {comma} > {dot} THEN {number(f"replace(replace({kept}, '.', ''), ',', '.')")}
      WHEN {comma} > 0 AND {dot} > 0 THEN {number(f"replace({kept}, ',', '')")}
      WHEN {comma} > 0 AND {places} = 2 THEN {number(f"replace({kept}, ',', '.')")}
      WHEN {comma} > 0 THEN {number(f"replace({kept}, ',', '')")}
      WHEN {dot} > 0 AND {dot_places} <> 2 THEN {number(f"replace({kept}, '.', '')")}
      ELSE {number(kept)} END"""
    if currency is None:
        return f"(CASE WHEN {kept} = '' THEN NULL ELSE {plain} END)"
    scaled = number(f"replace(replace({kept}, '.', ''), ',', '.')")
    return f"""(CASE WHEN {kept} = '' THEN NULL
      WHEN {currency} = 'IDR' AND regexp_matches({text}, '(?i)ribu|juta')
      THEN ({scaled}) * CASE WHEN regexp_matches({text}, '(?i)juta') THEN 1e6 ELSE 1e3 END
      ELSE {plain} END)"""


def cny(value: str) -> str:
    return f"(floor(({value} + 2.220446049250313e-16) * 100 + 0.5) / 100)"
