"""Check SQL for the registered queries, written independently of the DataFrame code.

All texts share one chain of common table expressions: raw panel, staging, resolution by self-joins,
vintage curves by a customer x age spine, cohort summary, findings.
"""

from __future__ import annotations

PANEL = """
WITH monthly AS (
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders,
         max(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS flag
  FROM orders GROUP BY 1, 2
), firsts AS (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_order FROM orders GROUP BY 1
), dated AS (
  SELECT m.*, m.month + 27 AS snapshot, c.*, n.*,
         CAST(f.first_order - to_months(CAST(c_custkey % 3 AS INTEGER)) AS DATE) AS acquired
  FROM monthly m
  JOIN firsts f ON f.o_custkey = m.o_custkey
  JOIN customer c ON c.c_custkey = m.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
), raw AS (
  SELECT
    CAST(o_custkey AS VARCHAR) AS ncodpers,
    strftime(snapshot, '%Y-%m-%d') AS fecha_dato,
    CASE WHEN c_custkey % 97 = 0 THEN 'not a date' ELSE strftime(acquired, '%Y-%m-%d') END AS fecha_alta,
    CASE WHEN c_custkey % 19 = 0 THEN '-999999' WHEN c_custkey % 23 = 0 THEN ' NA'
         ELSE lpad(CAST(date_diff('month', acquired, snapshot) AS VARCHAR), 7, ' ') END AS antiguedad,
    CASE WHEN c_custkey % 29 = 0 THEN '1.0' WHEN date_diff('month', acquired, snapshot) < 6 THEN '1' ELSE '0' END AS ind_nuevo,
    CASE WHEN c_custkey % 17 = 0 THEN ' NA' WHEN c_custkey % 83 = 0 THEN 'x'
         ELSE lpad(CAST(c_custkey % 90 AS VARCHAR), 3, ' ') END AS age,
    CASE WHEN c_custkey % 11 = 0 THEN '   NA' WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 89 = 0 THEN 'n/a'
         ELSE '  ' || CAST(CAST(round(c_acctbal * 20) AS BIGINT) AS VARCHAR) END AS renta,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '01 - TOP' WHEN c_mktsegment <> 'HOUSEHOLD' THEN '02 - RETAIL ' END AS segmento,
    CASE WHEN c_nationkey % 7 <> 0 THEN 'K' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS canal_entrada,
    ' ' || CAST(c_nationkey AS VARCHAR) AS cod_prov,
    n_name AS nomprov,
    'R' || CAST(n_regionkey AS VARCHAR) AS pais_residencia,
    CASE WHEN c_custkey % 31 = 0 THEN 'N ' ELSE 'S' END AS indresi,
    CASE WHEN c_custkey % 37 = 0 THEN ' S' ELSE 'N' END AS indext,
    CASE WHEN n_orders > 1 THEN '1' ELSE '0' END AS ind_actividad_cliente,
    CASE WHEN c_custkey % 41 = 0 THEN 'A' ELSE 'N' END AS ind_empleado,
    CASE WHEN c_custkey % 43 = 0 THEN '99' ELSE '1' END AS indrel,
    CASE WHEN n_orders > 1 THEN 'A' ELSE 'I' END AS tiprel_1mes,
    CAST(flag AS VARCHAR) AS ind_tjcr_fin_ult1
  FROM dated
), texts AS (
  SELECT *, trim(age) AS age_text, trim(renta) AS income_text, trim(antiguedad) AS seniority_text FROM raw
), numbers AS (
  SELECT *,
    CASE WHEN regexp_full_match(age_text, '[+-]?[0-9]+') THEN CAST(age_text AS BIGINT) END AS age_number,
    CASE WHEN income_text NOT IN ('NA', '') THEN TRY_CAST(income_text AS DOUBLE) END AS income_number,
    CASE WHEN regexp_full_match(seniority_text, '[+-]?[0-9]+') THEN CAST(seniority_text AS BIGINT) END AS seniority_number,
    CAST(try_strptime(fecha_alta, '%Y-%m-%d') AS DATE) AS joined
  FROM texts
), stg AS (
  SELECT
    CAST(ncodpers AS BIGINT) AS customer_id,
    CAST(fecha_dato AS DATE) AS snapshot_month,
    joined AS fecha_alta,
    CAST(date_trunc('month', joined) AS DATE) AS acq_month,
    CASE WHEN seniority_number >= 0 THEN seniority_number END AS seniority_months,
    CASE WHEN regexp_full_match(ind_nuevo, '[+-]?[0-9]+') THEN CAST(ind_nuevo AS BIGINT) END AS is_new_customer,
    age_number AS age,
    CASE WHEN age IS NULL OR age_text IN ('NA', '') THEN 'unknown' WHEN age_number < 18 THEN 'under_18'
         WHEN age_number < 25 THEN '18_24' WHEN age_number < 35 THEN '25_34' WHEN age_number < 45 THEN '35_44'
         WHEN age_number < 55 THEN '45_54' WHEN age_number < 65 THEN '55_64' ELSE '65_plus' END AS age_band,
    income_number AS income,
    CASE WHEN renta IS NULL OR income_text IN ('NA', '') THEN 'unknown' WHEN income_number < 30000 THEN 'low'
         WHEN income_number < 80000 THEN 'mid' WHEN income_number < 150000 THEN 'high' ELSE 'very_high' END AS income_band,
    trim(segmento) AS segmento, trim(canal_entrada) AS canal_entrada, trim(cod_prov) AS cod_prov,
    trim(nomprov) AS nomprov, trim(pais_residencia) AS pais_residencia, trim(indresi) AS indresi,
    trim(indext) AS indext, CAST(ind_actividad_cliente AS BIGINT) AS is_active, trim(ind_empleado) AS ind_empleado,
    trim(indrel) AS indrel, trim(tiprel_1mes) AS tiprel_1mes,
    CAST(ind_tjcr_fin_ult1 AS BIGINT) AS card_flag, ind_tjcr_fin_ult1 AS card_flag_raw
  FROM numbers
), profile AS (
  SELECT customer_id, max(acq_month) AS acq_month, min(snapshot_month) AS first_obs_month,
         max(snapshot_month) AS last_obs_month, count(snapshot_month) AS n_snapshots_observed,
         min(CASE WHEN card_flag = 1 THEN snapshot_month END) AS first_card_month,
         max(segmento) AS segmento, max(canal_entrada) AS canal_entrada, max(cod_prov) AS cod_prov,
         max(nomprov) AS nomprov, max(income_band) AS income_band, max(age_band) AS age_band,
         max(income) AS income_max, max(age) AS age_max
  FROM stg GROUP BY customer_id
), looked_up AS (
  SELECT p.*, coalesce(s0.card_flag, 0) AS at_first, coalesce(s1.card_flag, 0) AS at_1, coalesce(s2.card_flag, 0) AS at_2,
         coalesce(s3.card_flag, 0) AS at_3
  FROM profile p
  LEFT JOIN stg s0 ON s0.customer_id = p.customer_id AND s0.snapshot_month = p.first_obs_month
  LEFT JOIN stg s1 ON s1.customer_id = p.customer_id AND s1.snapshot_month = CAST(p.first_card_month + INTERVAL 1 MONTH AS DATE)
  LEFT JOIN stg s2 ON s2.customer_id = p.customer_id AND s2.snapshot_month = CAST(p.first_card_month + INTERVAL 2 MONTH AS DATE)
  LEFT JOIN stg s3 ON s3.customer_id = p.customer_id AND s3.snapshot_month = CAST(p.first_card_month + INTERVAL 3 MONTH AS DATE)
), res AS (
  SELECT customer_id, acq_month, first_obs_month, last_obs_month, n_snapshots_observed,
    n_snapshots_observed < date_diff('month', first_obs_month, last_obs_month) + 1 AS has_panel_gaps,
    coalesce(acq_month BETWEEN DATE '1995-01-01' AND DATE '2001-08-01', FALSE) AS is_within_panel_cohort,
    first_card_month,
    coalesce(at_first = 1 AND first_card_month = first_obs_month, FALSE) AS is_left_censored_card,
    coalesce(first_card_month > first_obs_month, FALSE) AS is_adopted_observed,
    coalesce(first_card_month > first_obs_month AND NOT (at_first = 1 AND first_card_month = first_obs_month), FALSE)
      AS is_adopted_clean,
    CASE WHEN first_card_month > first_obs_month THEN date_diff('month', acq_month, first_card_month) END AS months_to_adoption,
    CASE WHEN acq_month IS NOT NULL THEN acq_month > DATE '2001-02-01' END AS is_right_censored,
    CASE WHEN first_card_month > first_obs_month THEN at_1 = 1 END AS retained_1m,
    CASE WHEN first_card_month > first_obs_month THEN at_2 = 1 END AS retained_2m,
    CASE WHEN first_card_month > first_obs_month THEN at_3 = 1 END AS retained_3m,
    segmento, canal_entrada, cod_prov, nomprov, income_band, age_band, income_max, age_max
  FROM looked_up
), members AS (
  SELECT *, coalesce(segmento, 'unknown') AS seg FROM res WHERE is_within_panel_cohort
), spine AS (
  SELECT m.*, a.msa, CASE WHEN is_adopted_clean AND months_to_adoption <= a.msa THEN 1 ELSE 0 END AS adopted_by
  FROM members m CROSS JOIN (SELECT unnest(range(0, 18)) AS msa) a
), curves AS (
  SELECT acq_month, msa, CAST(acq_month + to_months(CAST(msa AS INTEGER)) AS DATE) AS as_of_month,
         count(*) AS n_observed, CAST(sum(adopted_by) AS BIGINT) AS n_adopted_clean,
         sum(adopted_by) / count(*) AS adoption_rate,
         acq_month + to_months(CAST(msa AS INTEGER)) > DATE '2001-08-01' AS is_cell_right_censored,
         acq_month + to_months(CAST(msa AS INTEGER)) <= DATE '2001-08-01' AS fully_observed_n
  FROM spine GROUP BY acq_month, msa
), curves_seg AS (
  SELECT acq_month, seg AS segmento, msa, CAST(acq_month + to_months(CAST(msa AS INTEGER)) AS DATE) AS as_of_month,
         count(*) AS n_observed, CAST(sum(adopted_by) AS BIGINT) AS n_adopted_clean,
         sum(adopted_by) / count(*) AS adoption_rate,
         acq_month + to_months(CAST(msa AS INTEGER)) > DATE '2001-08-01' AS is_cell_right_censored,
         acq_month + to_months(CAST(msa AS INTEGER)) <= DATE '2001-08-01' AS fully_observed_n
  FROM spine GROUP BY acq_month, seg, msa
), cohorts AS (
  SELECT acq_month, seg AS segmento, count(*) AS cohort_size,
    count(*) FILTER (WHERE is_adopted_clean) AS n_adopted,
    count(*) FILTER (WHERE is_adopted_clean) / count(*) AS adoption_rate,
    count(*) FILTER (WHERE is_right_censored) AS n_right_censored,
    bool_and(acq_month + INTERVAL 6 MONTH <= DATE '2001-08-01') AS fully_observed_6,
    bool_and(acq_month + INTERVAL 12 MONTH <= DATE '2001-08-01') AS fully_observed_12,
    avg(CASE WHEN is_adopted_clean THEN months_to_adoption END) AS avg_months_to_adoption,
    min(CASE WHEN is_adopted_clean THEN months_to_adoption END) AS min_months_to_adoption,
    max(CASE WHEN is_adopted_clean THEN months_to_adoption END) AS max_months_to_adoption,
    count(*) FILTER (WHERE retained_1m) / nullif(count(*) FILTER (WHERE is_adopted_clean), 0) AS retention_rate_1m,
    count(*) FILTER (WHERE retained_2m) / nullif(count(*) FILTER (WHERE is_adopted_clean), 0) AS retention_rate_2m,
    count(*) FILTER (WHERE retained_3m) / nullif(count(*) FILTER (WHERE is_adopted_clean), 0) AS retention_rate_3m,
    count(*) FILTER (WHERE has_panel_gaps) / count(*) AS share_with_panel_gaps
  FROM members GROUP BY acq_month, seg
), series AS (
  SELECT 'msa_' || msa AS win, strftime(acq_month, '%Y-%m') AS cohort, adoption_rate AS value
  FROM curves WHERE msa IN (3, 6, 12) AND fully_observed_n
), cells AS (
  SELECT 'msa_' || msa AS win, strftime(acq_month, '%Y-%m') AS cohort, segmento AS segment, adoption_rate AS value,
         n_observed AS n
  FROM curves_seg WHERE msa IN (3, 6, 12) AND fully_observed_n
), flags AS (
  SELECT 'msa_' || msa AS win, strftime(acq_month, '%Y-%m') AS cohort, fully_observed_n AS observed
  FROM curves WHERE msa IN (3, 6, 12)
), targets AS (
  SELECT *, lag(cohort) OVER (PARTITION BY win ORDER BY cohort) AS prior_cohort FROM flags
), deltas AS (
  SELECT *, round(value - prior_value, 6) AS delta FROM (
    SELECT *, lag(cohort) OVER w AS prior_cohort, lag(value) OVER w AS prior_value
    FROM series WINDOW w AS (PARTITION BY win ORDER BY cohort)
  ) WHERE prior_cohort IS NOT NULL
), measured AS (
  SELECT *, stddev_samp(delta) OVER w AS spread, count(delta) OVER w AS earlier
  FROM deltas WINDOW w AS (PARTITION BY win ORDER BY cohort ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, CASE WHEN earlier >= 3 THEN spread END AS sd, CASE WHEN earlier >= 3 THEN 1.5 * spread END AS threshold_sd,
    earlier < 3 AS insufficient_history,
    CASE WHEN earlier < 3 THEN abs(delta) >= 0.02 ELSE abs(delta) >= 0.02 AND abs(delta) > 1.5 * spread END AS material
  FROM measured
), seg_deltas AS (
  SELECT t.win, t.cohort, t.prior_cohort, c.segment, c.value, p.value AS prior_value, c.n,
         round(c.value - p.value, 6) AS delta
  FROM targets t
  JOIN cells c ON c.win = t.win AND c.cohort = t.cohort AND c.n >= 50
  JOIN cells p ON p.win = t.win AND p.cohort = t.prior_cohort AND p.segment = c.segment AND p.n >= 50
  WHERE t.observed
), finds AS (
  SELECT 'blended_delta' AS kind, win, CAST(NULL AS VARCHAR) AS segment, cohort, prior_cohort, value, prior_value,
         CAST(NULL AS BIGINT) AS n, delta, material, sd, threshold_sd, insufficient_history
  FROM judged
  UNION ALL
  SELECT 'segment_delta', win, segment, cohort, prior_cohort, value, prior_value, n, delta, abs(delta) >= 0.02,
         NULL, NULL, TRUE
  FROM seg_deltas
), sentences AS (
  SELECT win, cohort, string_agg(
      CASE WHEN segment IS NULL THEN 'The whole cohort'
           ELSE 'Segment ' || trim(regexp_replace(segment, '^\\s*\\d+\\s*-\\s*', '')) END
      || ' stands at ' || printf('%.2f%%', value * 100) || ' against ' || printf('%.2f%%', prior_value * 100)
      || ' for ' || prior_cohort || ', a change of ' || printf('%.2fpp', delta * 100) || '.',
      ' ' ORDER BY kind, segment) AS body
  FROM finds WHERE material GROUP BY win, cohort
), permitted AS (
  SELECT t.win, t.cohort,
    list_distinct(list_concat(
      [t.cohort, regexp_extract(t.win, '\\d+')],
      coalesce(flatten(list([f.cohort, f.prior_cohort, printf('%.2f%%', f.value * 100), printf('%.2f%%', f.prior_value * 100),
        printf('%.2fpp', f.delta * 100), printf('%.2fpp', abs(f.delta) * 100), coalesce(CAST(f.n AS VARCHAR), t.cohort)])
        FILTER (WHERE f.kind IS NOT NULL)), []))) AS allowed
  FROM targets t LEFT JOIN finds f ON f.win = t.win AND f.cohort = t.cohort
  WHERE t.observed GROUP BY t.win, t.cohort
), digests AS (
  SELECT t.win, t.cohort, t.observed,
    CASE WHEN t.observed THEN 'Cohort ' || t.cohort || ': ' || coalesce(s.body, 'No change is material.') END AS prose,
    p.allowed
  FROM targets t
  LEFT JOIN sentences s ON s.win = t.win AND s.cohort = t.cohort
  LEFT JOIN permitted p ON p.win = t.win AND p.cohort = t.cohort
)
"""

# white space as Unicode defines it, for engines whose \s is ASCII only
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FIGURE = rf"(?i)\p{{Nd}}{{4}}-\p{{Nd}}{{2}}|-?\p{{Nd}}[\p{{Nd}},]*(?:\.\p{{Nd}}+)?{SPACE}*(?:%|pp|bp|x)?"


def _tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{FIGURE}'), lambda t: replace(replace(lower(t), ' ', ''), ',', ''))"


def _wrong(text: str, allowed: str) -> str:
    """Figures of a text outside the allowed list, distinct, in order of appearance."""
    listed = f"list_filter({_tokens(text)}, lambda t: NOT list_contains({allowed}, t))"
    return f"list_filter({listed}, lambda t, i: list_position({listed}, t) = i)"


MEMBER_RATE = "SELECT strftime(acq_month, '%Y-%m') AS cohort, {value} AS value FROM {source} GROUP BY acq_month"


def _rate(msa: int) -> str:
    return f"""{PANEL} SELECT strftime(acq_month, '%Y-%m') AS cohort, sum(n_adopted_clean) / sum(n_observed) AS value
    FROM curves WHERE msa = {msa} AND NOT is_cell_right_censored GROUP BY acq_month"""


def _retention(months: int) -> str:
    return f"""{PANEL} SELECT * FROM (
      SELECT strftime(acq_month, '%Y-%m') AS cohort,
             round(sum(retention_rate_{months}m * n_adopted) / nullif(sum(n_adopted), 0), 9) AS value
      FROM cohorts GROUP BY acq_month) WHERE value IS NOT NULL"""


def _funnel(value: str) -> str:
    return f"""{PANEL} SELECT * FROM (
      SELECT strftime(acq_month, '%Y-%m') AS cohort, {value} AS value FROM members GROUP BY acq_month)
      WHERE value IS NOT NULL"""


def _adjusted(msa: int) -> str:
    return f"""{PANEL}, sizes AS (SELECT segmento, sum(cohort_size) AS n FROM cohorts GROUP BY segmento
    ), weights AS (SELECT segmento, n / sum(n) OVER () AS w FROM sizes)
    SELECT strftime(acq_month, '%Y-%m') AS cohort, round(sum(adoption_rate * w) / sum(w), 9) AS value
    FROM curves_seg JOIN weights USING (segmento)
    WHERE msa = {msa} AND NOT is_cell_right_censored GROUP BY acq_month"""


KEY = "md5(concat_ws('|', {}))"


def _key(*parts: str) -> str:
    return KEY.format(", ".join(f"coalesce(CAST({p} AS VARCHAR), '_null_')" for p in parts))


CUSTOMER_KEY = _key("segmento", "income_band", "age_band", "nomprov")
CHANNEL_KEY = _key("canal_entrada")

FCT = f"""
  SELECT customer_id, CAST(strftime(acq_month, '%Y%m') AS BIGINT) AS acq_date_key, {CUSTOMER_KEY} AS customer_key,
         {CHANNEL_KEY} AS channel_key, acq_month, first_obs_month, last_obs_month, first_card_month,
         is_within_panel_cohort, is_left_censored_card, is_adopted_observed, is_adopted_clean, is_right_censored,
         has_panel_gaps, months_to_adoption, n_snapshots_observed, retained_1m, retained_2m, retained_3m,
         segmento, income_band, age_band
  FROM res"""

DIM_CUSTOMER = f"""SELECT {CUSTOMER_KEY} AS customer_key, segmento, income_band, age_band, nomprov AS province
  FROM (SELECT DISTINCT segmento, income_band, age_band, nomprov FROM res)"""

DIM_CHANNEL = f"""SELECT {CHANNEL_KEY} AS channel_key, coalesce(canal_entrada, 'unknown') AS channel_code,
  coalesce('channel_' || lower(canal_entrada), 'channel_unknown') AS channel_label
  FROM (SELECT DISTINCT canal_entrada FROM stg)"""

FCT_MONTH = f"""
  SELECT {_key("s.customer_id", "s.snapshot_month")} AS customer_month_key, s.customer_id, s.snapshot_month, s.acq_month,
         date_diff('month', s.acq_month, s.snapshot_month) AS msa, s.card_flag, s.segmento, s.canal_entrada,
         s.income_band, s.age_band, s.nomprov, r.is_within_panel_cohort, r.is_adopted_clean, r.is_right_censored,
         r.has_panel_gaps
  FROM stg s LEFT JOIN res r ON r.customer_id = s.customer_id"""

DIM_DATE = """
  SELECT CAST(strftime(m, '%Y%m') AS BIGINT) AS date_key, m AS date_month, year(m) AS year, quarter(m) AS quarter,
         month(m) AS month, year(m) || '-Q' || quarter(m) AS year_quarter, strftime(m, '%b-%Y') AS month_label
  FROM (SELECT CAST(unnest(generate_series(
          (SELECT CAST(date_trunc('month', least(min(snapshot_month), min(acq_month))) AS DATE) FROM stg),
          (SELECT CAST(date_trunc('month', greatest(max(snapshot_month), max(acq_month))) AS DATE) FROM stg),
          INTERVAL 1 MONTH)) AS DATE) AS m)"""

CURVE_COLUMNS = "acq_month, msa, as_of_month, n_observed, n_adopted_clean, adoption_rate, is_cell_right_censored, fully_observed_n"
FIND_COLUMNS = """kind, 'adoption_rate' AS metric, win AS "window", segment, cohort, prior_cohort, value, prior_value, n, delta,
  material, abs(delta) AS abs_delta, round(sd, 9) AS sd, round(threshold_sd, 9) AS threshold_sd, insufficient_history"""

# Phrases that mark an attempt to redirect the answering system.
INJECTION_PATTERNS = (
    r"ignore (all |the )?previous",
    r"disregard (all |the )?(previous|above)",
    r"system prompt",
    r"reveal your (instructions|prompt)",
    r"you are now",
    r"act as",
    r"jailbreak",
)
INJECTION = "|".join(f"({p})" for p in INJECTION_PATTERNS)

# Words that mark a question as one about these metrics.
VOCABULARY = (
    "acquired", "acquisition", "adjusted", "adopted", "adoption", "card", "cohort", "conversion", "credit", "funnel",
    "metric", "msa", "rate", "retain", "retention", "segment", "segmento", "size", "time", "vintage", "window",
)


def _screen(table: str, columns: str, where: str = "TRUE") -> str:
    words = ", ".join(f"'{w}'" for w in VOCABULARY)
    return f"""SELECT {columns}, CASE WHEN length(text) > 500 THEN 'too_long'
      WHEN regexp_matches(lower(text), '{INJECTION}') THEN 'injection'
      WHEN list_has_any(regexp_extract_all(lower(text), '[a-z]+'), [{words}]) THEN 'on_topic'
      ELSE 'off_topic' END AS screen FROM {table} WHERE {where}"""


def _repeats(table: str, columns: str, where: str = "TRUE") -> str:
    key = f"sha256(trim(regexp_replace(lower(text), '{SPACE}+', ' ', 'g')))"
    return f"""SELECT {columns}, question_key,
      row_number() OVER (PARTITION BY question_key ORDER BY {columns}) > 1 AS is_repeat
      FROM (SELECT *, {key} AS question_key FROM {table} WHERE {where})"""


ADMISSION = """
  WITH slots AS (SELECT *, date_trunc('day', ts) AS bucket FROM events
  ), by_client AS (SELECT *, row_number() OVER (PARTITION BY bucket, user_id ORDER BY ts, event_id) AS r1 FROM slots
  ), passed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) AS r2 FROM by_client WHERE r1 <= 5)
"""

QUALITY_BRANCHES = {
    "stg": ("stg_customer_month", "stg"),
    "fct": ("fct_customer", f"({FCT})"),
    "month": ("fct_customer_month", f"({FCT_MONTH})"),
    "date": ("dim_date", f"({DIM_DATE})"),
    "dimc": ("dim_customer", f"({DIM_CUSTOMER})"),
    "dimch": ("dim_channel", f"({DIM_CHANNEL})"),
    "curves": ("mart_adoption_curves", "curves"),
    "curves_seg": ("mart_adoption_curves_by_segment", "curves_seg"),
    "cohorts": ("mart_cohort_adoption", "cohorts"),
}


def _quality() -> str:
    """Every data test spelled out as one counting branch."""
    parts: list[str] = []

    def branch(source: str, rule: str, columns: str, query: str) -> None:
        table = QUALITY_BRANCHES[source][0]
        parts.append(f"""SELECT '{table}' AS "table", '{rule}' AS rule, '{columns}' AS columns, ({query}) AS failures""")

    def rows(source: str, rule: str, column: str, condition: str) -> None:
        branch(source, rule, column, f"SELECT count(*) FROM {QUALITY_BRANCHES[source][1]} WHERE {condition}")

    def filled(source: str, columns: str) -> None:
        for column in columns.split():
            rows(source, "not_null", column, f"{column} IS NULL")

    def once(source: str, rule: str, columns: str) -> None:
        branch(
            source, rule, columns,
            f"SELECT count(*) FROM (SELECT 1 FROM {QUALITY_BRANCHES[source][1]} GROUP BY {columns} HAVING count(*) > 1)",
        )

    def within(source: str, column: str) -> None:
        rows(source, "accepted_range", column, f"{column} < 0 OR {column} > 1")

    def has_parent(source: str, column: str, parent: str, key: str | None = None) -> None:
        rows(
            source, "relationships", column,
            f"{column} IS NOT NULL AND {column} NOT IN (SELECT {key or column} FROM {QUALITY_BRANCHES[parent][1]})",
        )

    filled("stg", "customer_id snapshot_month card_flag")
    rows(
        "stg", "accepted_values", "age_band",
        "age_band NOT IN ('under_18','18_24','25_34','35_44','45_54','55_64','65_plus','unknown')",
    )
    rows("stg", "accepted_values", "income_band", "income_band NOT IN ('low','mid','high','very_high','unknown')")
    rows("stg", "accepted_values", "card_flag", "card_flag NOT IN (0, 1)")
    once("stg", "unique_combination", "customer_id,snapshot_month")
    filled("date", "date_key date_month")
    once("date", "unique", "date_key")
    filled("dimc", "customer_key")
    once("dimc", "unique", "customer_key")
    filled("dimch", "channel_key")
    once("dimch", "unique", "channel_key")
    filled(
        "fct",
        "customer_id customer_key channel_key is_within_panel_cohort is_left_censored_card is_adopted_observed "
        "is_adopted_clean has_panel_gaps",
    )
    once("fct", "unique", "customer_id")
    has_parent("fct", "customer_key", "dimc")
    has_parent("fct", "channel_key", "dimch")
    has_parent("fct", "acq_date_key", "date", "date_key")
    filled(
        "month",
        "customer_month_key customer_id snapshot_month card_flag is_within_panel_cohort is_adopted_clean has_panel_gaps",
    )
    once("month", "unique", "customer_month_key")
    rows("month", "accepted_values", "card_flag", "card_flag NOT IN (0, 1)")
    has_parent("month", "customer_id", "fct")
    curve = "msa as_of_month n_observed n_adopted_clean adoption_rate is_cell_right_censored fully_observed_n"
    filled("curves", "acq_month " + curve)
    within("curves", "adoption_rate")
    once("curves", "unique_combination", "acq_month,msa")
    filled("curves_seg", "acq_month segmento " + curve)
    within("curves_seg", "adoption_rate")
    once("curves_seg", "unique_combination", "acq_month,segmento,msa")
    filled(
        "cohorts",
        "acq_month segmento cohort_size n_adopted adoption_rate n_right_censored fully_observed_6 fully_observed_12",
    )
    for column in ("adoption_rate", "retention_rate_1m", "retention_rate_2m", "retention_rate_3m", "share_with_panel_gaps"):
        within("cohorts", column)
    once("cohorts", "unique_combination", "acq_month,segmento")
    return PANEL + "\nUNION ALL\n".join(parts)


def _digest_rows(run: str, stamp: str, where: str = "TRUE") -> str:
    return f"""SELECT cohort AS cohort_month, win AS metric_window, {run} AS dbt_run_id, {stamp} AS generated_at, prose,
      TRUE AS faithful, (SELECT count(*) FROM finds f WHERE f.win = d.win AND f.cohort = d.cohort AND f.material)
        AS material_findings
      FROM digests d WHERE observed AND len({_wrong("prose", "allowed")}) = 0 AND {where}"""


STAMP = "CAST(cohort || '-01' AS TIMESTAMP)"


def oracle_sql() -> dict[str, str]:
    texts = {
        "staging_clean": f"{PANEL} SELECT * FROM stg",
        "staging_bands": f"""{PANEL} SELECT age_band, income_band, count(*) AS n, count(age) AS n_age, count(income) AS n_income,
            count(seniority_months) AS n_seniority, count(acq_month) AS n_cohort FROM stg GROUP BY 1, 2""",
        "ingest_strings": f"{PANEL} SELECT * FROM raw",
        "adoption_resolved": f"{PANEL} SELECT * FROM res",
        "dim_date": f"{PANEL} {DIM_DATE}",
        "dim_customer": f"{PANEL} {DIM_CUSTOMER}",
        "dim_channel": f"{PANEL} {DIM_CHANNEL}",
        "fct_customer": f"{PANEL} {FCT}",
        "fct_customer_month": f"{PANEL} {FCT_MONTH}",
        "adoption_curves": f"{PANEL} SELECT {CURVE_COLUMNS} FROM curves",
        "adoption_curves_by_segment": f"{PANEL} SELECT segmento, {CURVE_COLUMNS} FROM curves_seg",
        "cohort_adoption": f"{PANEL} SELECT * FROM cohorts",
        "m_cohort_size": f"""{PANEL} SELECT strftime(acq_month, '%Y-%m') AS cohort, CAST(sum(cohort_size) AS BIGINT) AS value
            FROM cohorts GROUP BY acq_month""",
        "m_adoption_rate_3": _rate(3),
        "m_adoption_rate_6": _rate(6),
        "m_adoption_rate_12": _rate(12),
        "m_adoption_rate_by_segment": f"""{PANEL} SELECT cohort, segment, value, n FROM cells WHERE win = 'msa_6'""",
        "m_adoption_rate_adjusted": _adjusted(6),
        "m_adoption_rate_adjusted_3": _adjusted(3),
        "m_adoption_rate_adjusted_12": _adjusted(12),
        "m_time_to_adoption": f"""{PANEL} SELECT * FROM (
            SELECT strftime(acq_month, '%Y-%m') AS cohort,
                   round(sum(avg_months_to_adoption * n_adopted) / nullif(sum(n_adopted), 0), 9) AS value
            FROM cohorts GROUP BY acq_month) WHERE value IS NOT NULL""",
        "m_retention_1m": _retention(1),
        "m_retention_2m": _retention(2),
        "m_retention_3m": _retention(3),
        "m_funnel_adopted": _funnel("count(*) FILTER (WHERE is_adopted_clean) / count(*)"),
        "m_funnel_retained": _funnel(
            "count(*) FILTER (WHERE is_adopted_clean AND retained_3m) / nullif(count(*) FILTER (WHERE is_adopted_clean), 0)"
        ),
        "m_segment_mix": f"""{PANEL} SELECT strftime(acq_month, '%Y-%m') AS cohort, segmento AS dimension,
            cohort_size / sum(cohort_size) OVER (PARTITION BY acq_month) AS share FROM cohorts""",
        "m_compare_cohorts": f"""{PANEL}, picked AS (
            SELECT (SELECT value FROM series WHERE win = 'msa_6' AND cohort = '1995-05') AS value_a,
                   (SELECT value FROM series WHERE win = 'msa_6' AND cohort = '1995-01') AS value_b)
            SELECT 'adoption_rate' AS metric, 'msa_6' AS "window", '1995-05' AS cohort_a, value_a, '1995-01' AS cohort_b,
                   value_b, value_a - value_b AS difference FROM picked""",
        "guard_target": f"""{PANEL}, placed AS (
            SELECT win, cohort, lead(cohort) OVER w AS prior_cohort, row_number() OVER w AS place
            FROM series WINDOW w AS (PARTITION BY win ORDER BY cohort DESC))
            SELECT win AS "window", cohort, prior_cohort FROM placed WHERE place = 1 AND prior_cohort IS NOT NULL""",
        "guard_censoring": f"""{PANEL} SELECT win AS "window", cohort, prior_cohort, observed AS is_observed FROM targets""",
        "guard_min_n": f"""{PANEL} SELECT win AS "window", cohort, segment, n, CASE WHEN n < 50 THEN 'min_n' END AS reason,
            CASE WHEN n >= 50 THEN value END AS value FROM cells""",
        "guard_deltas": f"""{PANEL} SELECT win AS "window", cohort, value, prior_cohort, prior_value, delta FROM deltas""",
        "guard_materiality": f"""{PANEL} SELECT win AS "window", cohort, delta, material, abs(delta) AS abs_delta,
            round(sd, 9) AS sd, round(threshold_sd, 9) AS threshold_sd, insufficient_history FROM judged""",
        "guard_findings": f"{PANEL} SELECT {FIND_COLUMNS} FROM finds",
        "guard_suppressed": f"""{PANEL} SELECT t.win AS "window", t.cohort, s.side, 'min_n' AS reason, c.segment, c.n
            FROM targets t CROSS JOIN (VALUES (0), (1)) s(side)
            JOIN cells c ON c.win = t.win AND c.cohort = CASE side WHEN 0 THEN t.cohort ELSE t.prior_cohort END AND c.n < 50
            WHERE t.observed""",
        "guard_critique": f"""{PANEL} SELECT t.cohort AS cohort_month, t.win AS "window", t.observed AS critic_passed,
            (SELECT count(*) FROM finds f WHERE f.win = t.win AND f.cohort = t.cohort) AS n_findings,
            CASE WHEN t.observed THEN (SELECT count(*) FROM cells c WHERE c.win = t.win AND c.n < 50
                                        AND c.cohort IN (t.cohort, t.prior_cohort)) ELSE 1 END AS n_suppressed,
            (SELECT count(*) FROM judged j WHERE j.win = t.win AND j.cohort = t.cohort AND j.insufficient_history) AS n_notes
            FROM targets t""",
        "guard_panel_gaps": f"""{PANEL} SELECT acq_month, segmento, cohort_size, share_with_panel_gaps FROM cohorts
            WHERE share_with_panel_gaps > 0.05""",
        "digest_tokens": f"""SELECT doc_id, array_to_string({_tokens("text")}, '|') AS tokens,
            CAST(len({_tokens("text")}) AS INTEGER) AS n_tokens FROM documents""",
        "digest_allowed": f"""{PANEL} SELECT win AS "window", cohort AS cohort_month,
            array_to_string(list_sort(allowed), '|') AS allowed FROM digests WHERE observed""",
        "digest_faithfulness": f"""{PANEL}, variants AS (
            SELECT win, cohort, allowed, 'written' AS variant, prose FROM digests WHERE observed
            UNION ALL
            SELECT win, cohort, allowed, 'altered', prose || ' That is 99.99% more, and 99.99% again.' FROM digests WHERE observed
            ), checked AS (SELECT *, {_wrong("prose", "allowed")} AS wrong FROM variants)
            SELECT win AS "window", cohort AS cohort_month, variant, prose, len(wrong) = 0 AS faithful,
                   array_to_string(wrong, '|') AS violations FROM checked""",
        "digest_rows": f"""{PANEL} {_digest_rows("'run_1'", STAMP)}""",
        "digest_upsert": f"""{PANEL}, old AS ({_digest_rows("'run_1'", STAMP, "win = 'msa_12'")}
            ), new AS ({_digest_rows("CASE WHEN substr(cohort, 6) <= '06' THEN 'run_1' ELSE 'run_2' END", STAMP, "win = 'msa_6'")})
            SELECT * FROM new UNION ALL
            SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.cohort_month = old.cohort_month
                                                 AND new.dbt_run_id = old.dbt_run_id)""",
        "digest_latest": f"""{PANEL} {_digest_rows("'run_1'", STAMP, "win = 'msa_6'")} ORDER BY generated_at DESC LIMIT 1""",
        "bi_curves": f"""{PANEL} SELECT {CURVE_COLUMNS}, strftime(acq_month, '%Y-%m') AS acq_month_label FROM curves""",
        "bi_curves_censored": f"""{PANEL} SELECT {CURVE_COLUMNS}, strftime(acq_month, '%Y-%m') AS acq_month_label FROM curves
            WHERE msa <= 12 AND NOT fully_observed_n""",
        "bi_funnel": f"""{PANEL}, f AS (SELECT count(*) AS acquired, count(*) FILTER (WHERE is_adopted_clean) AS adopted,
            count(*) FILTER (WHERE is_adopted_clean AND retained_3m) AS retained_3m FROM members)
            SELECT *, adopted / nullif(acquired, 0) AS adopted_of_acquired, retained_3m / nullif(adopted, 0) AS retained_of_adopted,
                   retained_3m / nullif(acquired, 0) AS retained_of_acquired FROM f""",
        "bi_heatmap": f"""{PANEL} SELECT acq_month, segmento, cohort_size, n_adopted, adoption_rate, fully_observed_6,
            fully_observed_12, n_right_censored, strftime(acq_month, '%Y-%m') AS acq_month_label
            FROM cohorts WHERE fully_observed_6""",
        "bi_heatmap_pivot": f"""{PANEL} SELECT strftime(acq_month, '%Y-%m') AS acq_month_label,
            avg(adoption_rate) FILTER (WHERE segmento = '01 - TOP') AS "01 - TOP",
            avg(adoption_rate) FILTER (WHERE segmento = '02 - RETAIL') AS "02 - RETAIL",
            avg(adoption_rate) FILTER (WHERE segmento = 'unknown') AS "unknown"
            FROM cohorts WHERE fully_observed_6 GROUP BY acq_month""",
        "dq_panel": _quality(),
        "text_screen": _screen("conversations", "conv_id, turn", "role = 'user'"),
        "text_screen_documents": _screen("documents", "doc_id"),
        "text_repeats": _repeats("conversations", "conv_id, turn", "role = 'user'"),
        "text_repeats_documents": _repeats("documents", "doc_id"),
        "request_admission": f"""{ADMISSION} SELECT e.event_id, e.user_id, e.ts, date_trunc('day', e.ts) AS bucket,
            coalesce(p.r2 <= 300, FALSE) AS admitted FROM events e LEFT JOIN passed p USING (event_id)""",
        "request_admission_counts": f"""{ADMISSION} SELECT b.bucket, b.requests, p.n AS within_client_cap,
            least(p.n, 300) AS admitted FROM (SELECT bucket, count(*) AS requests FROM slots GROUP BY 1) b
            JOIN (SELECT bucket, count(*) AS n FROM passed GROUP BY 1) p USING (bucket)""",
        # one start after another, as a limiter would see them
        "request_windows": """WITH RECURSIVE starts AS (
                SELECT min(ts) AS window_start FROM events
                UNION ALL
                SELECT min(e.ts) FROM starts s JOIN events e ON e.ts >= s.window_start + INTERVAL 1 DAY HAVING min(e.ts) IS NOT NULL
            ), slots AS (
                SELECT e.event_id, e.user_id, e.ts, s.window_start FROM events e ASOF LEFT JOIN starts s ON e.ts >= s.window_start
            ), first AS (
                SELECT *, row_number() OVER (PARTITION BY window_start, user_id ORDER BY ts, event_id) AS r1 FROM slots WHERE window_start IS NOT NULL
            ), passed AS (
                SELECT event_id, row_number() OVER (PARTITION BY window_start ORDER BY ts, event_id) AS r2 FROM first WHERE r1 <= 5
            )
            SELECT s.event_id, s.user_id, s.ts, s.window_start, coalesce(p.r2 <= 300, FALSE) AS admitted
            FROM slots s LEFT JOIN passed p USING (event_id)""",
    }
    texts["stream_incremental"] = texts["adoption_curves"]
    texts["table_if_absent"] = texts["dim_customer"]
    texts["view_of_table"] = f"""{PANEL} SELECT channel_label, channel_code FROM ({DIM_CHANNEL}) WHERE channel_code <> 'unknown'"""
    texts["m_adoption_rate_cohort"] = f"SELECT * FROM ({_rate(6)}) WHERE cohort = '1995-05'"
    written = f"""{PANEL}, kept AS (SELECT win, cohort FROM digests WHERE observed AND len({_wrong("prose", "allowed")}) = 0)"""
    texts["digest_json"] = f"""{written} SELECT cohort AS cohort_month, win AS metric_window, kind, segment, cohort, prior_cohort,
        value, prior_value, n, delta, material FROM finds JOIN kept USING (win, cohort)"""
    texts["digest_json_suppressed"] = f"""{written} SELECT k.cohort AS cohort_month, k.win AS metric_window, TRUE AS suppressed,
        'min_n' AS reason, c.segment, c.n FROM kept k JOIN targets t USING (win, cohort)
        JOIN cells c ON c.win = k.win AND c.n < 50 AND c.cohort IN (t.cohort, t.prior_cohort)"""
    texts["digest_json_notes"] = f"""{written} SELECT cohort AS cohort_month, win AS metric_window,
        (SELECT count(*) FROM judged j WHERE j.win = k.win AND j.cohort = k.cohort AND j.insufficient_history) AS n_notes FROM kept k"""
    texts["digest_payload"] = f"""{PANEL} SELECT win AS observation_window, kind AS change_type, material,
        trim(regexp_replace(segment, '^\\s*\\d+\\s*-\\s*', '')) AS segment, cohort, prior_cohort,
        printf('%.2f%%', value * 100) AS adoption_rate, printf('%.2f%%', prior_value * 100) AS prior_adoption_rate,
        printf('%.2fpp', delta * 100) AS change_pp, n AS cohort_cell_size FROM finds"""
    texts["stream_incremental_cohorts"] = texts["cohort_adoption"]
    texts["stream_incremental_customers"] = texts["fct_customer"]
    texts["stream_admission"] = texts["request_admission_counts"]
    texts["stream_decisions"] = f"""SELECT * FROM ({texts["request_admission"]})
        WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
    texts["warehouse_build"] = texts["fct_customer_month"]
    return texts
