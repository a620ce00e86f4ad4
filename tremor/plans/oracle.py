"""SQL twins of the adapters, as named common table expressions.

``sql(q)`` prepends the expressions that ``q`` mentions, in definition order.
Double literals carry an exponent so that arithmetic is never decimal.
"""

from __future__ import annotations

import re

from tremor import dims
from tremor.plans import fixtures as FX


def _values(rows) -> str:
    q = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"{float(v)!r}e0" if isinstance(v, float) else str(v))
    return ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)


_ACT = _values([(t, ch, float(v)) for t, vs in dims.ACTIVATION.items() for ch, v in vs.items()])
_REL = "CASE label_source " + " ".join(f"WHEN '{s}' THEN {v!r}e0" for s, v in dims.RELIABILITY.items()) + " ELSE 0e0 END"
_BAND = ("CASE WHEN {s} < 0.15e0 THEN 1 WHEN {s} < 0.35e0 THEN 2 WHEN {s} < 0.55e0 THEN 3 "
         "WHEN {s} < 0.75e0 THEN 4 ELSE 5 END")


def band(expr: str) -> str:
    return _BAND.format(s=f"({expr})")


CTES = {
    "ev": """SELECT event_id AS eid, CAST(event_id AS VARCHAR) AS event_id, ts AS published_at, CAST(ts AS DATE) AS d,
        user_id, event_type AS raw_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k0,
        CAST(1 + event_id % 4 AS INTEGER) AS quad, ((event_id * 37) % 201 - 100) / 10e0 AS goldstein,
        'NATION_' || (user_id % 25) AS actor1, 'NATION_' || ((user_id * 7) % 25) AS actor2 FROM events""",
    "lab": f"""SELECT event_id, eid, published_at, d,
        CASE eid % 5 WHEN 0 THEN 'gdelt_derived' WHEN 1 THEN 'rule_based' WHEN 2 THEN 'llm_assisted'
             WHEN 3 THEN 'manual' ELSE 'ollama_assisted' END AS label_source,
        CASE raw_type WHEN 'error' THEN 'supply_chain_fab_disruption' WHEN 'click' THEN 'geopolitical_military_tension'
             WHEN 'signup' THEN 'corporate_strategic' WHEN 'purchase' THEN 'macroeconomic_conditions'
             ELSE 'unclassified' END AS event_type,
        CAST({band('k0 / 100e0')} AS INTEGER) AS severity, k0 / 100e0 AS severity_score,
        0.25e0 + 0.1e0 * (eid % 7) AS confidence,
        CASE WHEN eid % 3 <> 0 THEN goldstein / 10e0 END AS polarity,
        list_sort(list_distinct([actor1, actor2])) AS countries FROM ev""",
    "rawev": """SELECT event_id AS id, eid, CASE WHEN eid % 2 = 0 THEN 'rss' ELSE 'gdelt' END AS source, published_at, d,
        CASE WHEN eid % 3 = 0 THEN 'headline ' || event_id END AS title, 'body ' || raw_type AS text,
        'http://example.com/' || (eid % 997) AS url FROM ev""",
    "led": """SELECT event_id, CASE WHEN eid % 2 = 0 THEN 'confirm_stage2' ELSE 'reject_stage2' END AS verdict
        FROM ev WHERE eid % 2 = 0 OR eid % 7 = 1""",
    "scorable": """SELECT lab.* FROM lab WHERE event_type <> 'unclassified'
        AND (label_source <> 'gdelt_derived' OR event_type <> 'geopolitical_military_tension'
             OR EXISTS (SELECT 1 FROM led g WHERE g.event_id = lab.event_id AND g.verdict = 'confirm_stage2'))""",
    "rev": """SELECT n_name AS country, p_brand AS stock, o_orderpriority AS pr, c_mktsegment AS seg,
        SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS rev
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "shares": """SELECT country AS src, stock AS dst, CASE pr WHEN '1-URGENT' THEN 'manufacturing' WHEN '2-HIGH' THEN 'demand'
        WHEN '3-MEDIUM' THEN 'policy' ELSE 'supply' END AS channel, SUM(rev) AS w FROM rev WHERE pr <> '5-LOW' GROUP BY ALL
        UNION ALL SELECT country, seg, 'sector_broad', SUM(rev) FROM rev WHERE pr = '5-LOW' GROUP BY ALL""",
    "down": """SELECT seg AS src, stock AS dst, SUM(rev) AS w FROM rev WHERE pr = '5-LOW' GROUP BY ALL""",
    "edg0": """SELECT src, dst, channel,
        CAST(w AS DOUBLE) / CAST(SUM(w) OVER (PARTITION BY dst, channel) AS DOUBLE) / 10e0 AS weight FROM shares
        UNION ALL SELECT src, dst, NULL, CAST(w AS DOUBLE) / CAST(MAX(w) OVER (PARTITION BY src) AS DOUBLE) FROM down""",
    "edg": """SELECT *, '§' || src || '-' || dst || ': ' || coalesce(channel, 'beta') || ' share' AS note FROM edg0""",
    "stk": """SELECT DISTINCT p_brand AS ticker FROM part""",
    "nod": """SELECT n_name AS name, 'country' AS node_type FROM nation
        UNION ALL SELECT DISTINCT c_mktsegment, 'sector' FROM customer UNION ALL SELECT ticker, 'stock' FROM stk""",
    "act": f"SELECT * FROM (VALUES {_ACT}) t(event_type, channel, activation)",
    "hop1": """SELECT e.src AS country, e.channel, e.weight AS w, e.dst AS node, [e.src, e.dst] AS path
        FROM edg e JOIN nod n ON n.name = e.src AND n.node_type = 'country'""",
    "hop2": """SELECT p.country, p.channel, p.w * e.weight AS w, e.dst AS node, list_append(p.path, e.dst) AS path
        FROM hop1 p JOIN edg e ON e.src = p.node AND NOT list_contains(p.path, e.dst)""",
    "pth": """SELECT q.country, q.channel, q.w, q.node AS stock, q.path FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) q
        JOIN nod n ON n.name = q.node AND n.node_type = 'stock'""",
    "rch": """SELECT country, event_type, stock, activation * w AS imp, path FROM pth JOIN act USING (channel)
        QUALIFY row_number() OVER (PARTITION BY country, event_type, stock ORDER BY activation * w DESC, len(path), path) = 1""",
    "kev": f"""SELECT *, severity_score * confidence * ({_REL}) AS k, countries AS corridor,
        array_to_string(countries, '|') AS ck FROM scorable""",
    "clu": """SELECT d AS cluster_date, event_type, ck, corridor, k, event_id, label_source, polarity, severity_score, confidence,
        countries, published_at FROM kev
        QUALIFY row_number() OVER (PARTITION BY d, event_type, ck ORDER BY k DESC, event_id, label_source) = 1""",
    "cre": """SELECT ck, event_type, stock, imp, path FROM
        (SELECT ck, event_type, unnest(corridor) AS country FROM (SELECT DISTINCT ck, event_type, corridor FROM clu)) x
        JOIN rch USING (country, event_type) WHERE imp > 0
        QUALIFY row_number() OVER (PARTITION BY ck, event_type, stock ORDER BY imp DESC, len(path), path) = 1""",
    "cnp": """SELECT ck || '#' || event_type AS ce, stock, max(imp) AS imp FROM (SELECT ck, event_type, unnest(corridor) AS country
        FROM (SELECT DISTINCT ck, event_type, corridor FROM clu)) x JOIN rch USING (country, event_type) WHERE imp > 0 GROUP BY ALL""",
    "con0": """SELECT clu.*, cre.stock AS ticker, cre.imp, cre.path, CAST(a AS INTEGER) AS days_since,
        CAST(cluster_date + CAST(a AS INTEGER) AS DATE) AS date, pow(0.5e0, a / 5e0) AS tau
        FROM clu JOIN cre USING (ck, event_type) CROSS JOIN range(0, 35) t(a)
        WHERE cluster_date + CAST(a AS INTEGER) <= (SELECT max(d) FROM ev) AND pow(0.5e0, a / 5e0) >= 0.01e0""",
    "con": """SELECT *, k * imp * tau AS contribution FROM con0 WHERE k * imp * tau > 0""",
    "cal": """SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM stk, (SELECT min(d) AS lo, max(d) AS hi FROM ev)""",
    "dly": """SELECT ticker, date, coalesce(1 - x.prod, 0e0) AS score, x.direction, coalesce(x.cov, 0e0) AS direction_coverage,
        coalesce(x.n, 0) AS n_clusters FROM cal LEFT JOIN
        (SELECT ticker, date, product(1 - contribution) AS prod,
         sum(contribution * polarity) / nullif(sum(contribution) FILTER (polarity IS NOT NULL), 0) AS direction,
         sum(contribution) FILTER (polarity IS NOT NULL) / sum(contribution) AS cov, count(*) AS n FROM con GROUP BY ALL) x
        USING (ticker, date)""",
    "att": """SELECT * FROM (SELECT ticker, date, CAST(row_number() OVER (PARTITION BY ticker, date
          ORDER BY contribution DESC, cluster_date DESC, event_id, label_source) AS INTEGER) AS rank,
        event_id, label_source, event_type, corridor, ck, path, cluster_date, contribution, imp, tau, days_since, k AS k_value FROM con)
        WHERE rank <= 5""",
    "cat": """SELECT DISTINCT ON (c.event_id, c.label_source) c.event_id, c.label_source, c.event_type, c.severity_score, c.confidence,
        c.polarity, c.countries, c.published_at, r.title, r.url FROM clu c LEFT JOIN rawev r ON r.id = c.event_id""",
    "bar0": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity,
        row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS key
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars": """SELECT ticker, date, arg_min(price, key) AS open, max(price) AS high, min(price) AS low, arg_max(price, key) AS close,
        arg_max(price, key) AS adj_close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM bar0 GROUP BY ticker, date""",
    "sco": f"""SELECT ticker, date, dayofyear(date) / 366e0 AS score FROM bars
        WHERE date_diff('day', DATE '1970-01-01', date) % 5 <> 0 AND date >= DATE '{FX.SCORES_FROM}'""",
    "ret": """SELECT ticker, date, adj_close, adj_close / nullif(lag(adj_close) OVER w, 0) - 1 AS daily_return FROM bars
        WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "ind": """SELECT ticker, date, adj_close, daily_return,
        CASE WHEN count(adj_close) OVER s = 10 THEN avg(adj_close) OVER s END AS sma_short,
        CASE WHEN count(adj_close) OVER l = 50 THEN avg(adj_close) OVER l END AS sma_long,
        CASE WHEN count(daily_return) OVER s = 10 THEN stddev_samp(daily_return) OVER s END AS volatility_10 FROM ret
        WINDOW s AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
               l AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "jnd": """SELECT ind.*, sco.score, sco.date AS score_source_date FROM ind ASOF LEFT JOIN sco
        ON ind.ticker = sco.ticker AND ind.date >= sco.date""",
    "ftr0": """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM jnd
        WHERE score IS NOT NULL AND daily_return IS NOT NULL AND sma_short IS NOT NULL AND sma_long IS NOT NULL
        AND volatility_10 IS NOT NULL""",
    "ftr": """SELECT *, CASE WHEN rn <= round_even(n * 0.7e0, 0) THEN 'train'
        WHEN rn <= round_even(n * 0.7e0, 0) + round_even(n * 0.15e0, 0) THEN 'val' ELSE 'test' END AS split FROM ftr0""",
    "bnd": """SELECT ticker, split, min(date) AS start_date, max(date) AS end_date, count(*) AS n_rows,
        min(date) FILTER (rn > 60) AS first_usable_label_date, count(*) FILTER (rn > 60) AS n_usable_labels FROM ftr GROUP BY ALL""",
    "prd0": """SELECT ticker, date AS label_date, split, daily_return AS actual, lag(daily_return) OVER w AS prior,
        lag(date) OVER w AS prior_date, avg(daily_return) OVER f AS p, score, rn FROM ftr
        WINDOW w AS (PARTITION BY ticker ORDER BY date),
               f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "prd": """SELECT ticker, label_date, prior_date, split, actual, prior, 'baseline' AS variant, p AS predicted FROM prd0 WHERE rn > 5
        UNION ALL SELECT ticker, label_date, prior_date, split, actual, prior, 'with_score', p + (score - 0.5e0) * prior FROM prd0 WHERE rn > 5""",
    "pst": """SELECT ticker, (rn - 1) // 5 AS window_id, CAST((rn - 1) % 5 + 1 AS INTEGER) AS step,
        CAST(((rn - 1) // 5) % 4 AS INTEGER) AS fold_id, daily_return AS actual FROM ftr""",
    "smp": """SELECT pst.*, CAST(s AS INTEGER) AS sample_id,
        actual * (1e0 + (s - 10) / 40e0) + (((window_id % 7) - 3) / 10e0) * 0.5e0 + ((s - 10) / 40e0) * 0.6e0 AS value
        FROM pst CROSS JOIN range(1, 21) t(s)""",
    "bnq": """SELECT ticker, window_id, step, fold_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi,
        min(actual) AS actual FROM smp GROUP BY ticker, window_id, step, fold_id""",
    "ncf": """SELECT *, greatest(lo - actual, actual - hi) AS s FROM bnq""",
    "cqr0": """SELECT step, s, row_number() OVER (PARTITION BY step ORDER BY s) AS r, count(*) OVER (PARTITION BY step) AS n
        FROM ncf WHERE fold_id < 3""",
    "cqr": """SELECT step, max(n) AS n_cal, coalesce(max(CASE WHEN r = ceil((n + 1) * 0.9e0) THEN s END), CAST('inf' AS DOUBLE)) AS q_hat
        FROM cqr0 GROUP BY step""",
    "fcs": """SELECT ticker, 'with_score' AS variant, as_of_date, CAST(h AS INTEGER) AS horizon_step,
        CAST(as_of_date + CAST(h AS INTEGER) AS DATE) AS target_date, close * (1e0 + h / 1000e0) AS point_price,
        close * (1e0 + h / 1000e0) * 0.9e0 AS lo_price, close * (1e0 + h / 1000e0) * 1.1e0 AS hi_price FROM
        (SELECT ticker, close, CAST(unnest([last, last - 40]) AS DATE) AS as_of_date FROM
          (SELECT ticker, max(date) AS last, arg_max(close, date) AS close FROM bars GROUP BY ticker))
        CROSS JOIN range(1, 31) t(h)""",
    "doc": """SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, split_part(text, chr(10), 1) AS title, text, lang, source,
        regexp_replace(split_part(text, chr(10), 1) || ' ' || text, '^\\s+|\\s+$', '', 'g') AS alltext FROM documents""",
    "jdg": """SELECT d.doc_id, d.text, d.lang, CAST(l.quality AS VARCHAR) AS gold,
        CASE WHEN d.n_chars % 3 = 0 THEN '0' ELSE '1' END AS pred, l.toxic FROM documents d JOIN labels l USING (doc_id)""",
}


def sql(query: str, **extra: str) -> str:
    """``query`` with every expression it needs in front of it."""
    names = list(CTES)
    bodies = {**CTES, **extra}
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in bodies:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(bodies[name])

    visit(query)
    order = [n for n in [*names, *extra] if n in need]
    if not order:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({bodies[n]})" for n in order) + "\n" + query
