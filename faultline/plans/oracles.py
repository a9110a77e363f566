"""Reference answers in SQL for the registered queries, written for DuckDB.

Common table expressions are named once and pulled in by the queries that need them.
"""

MIN_US = 60_000_000


def _pick(names: list[str], number: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE ({number}) % {len(names)} {whens} END"


def _round_bucket(ts: str, minutes: int) -> str:
    w = minutes * MIN_US
    return (
        f"make_timestamp(CASE WHEN epoch_us({ts}) % {w} * 2 > {w} OR (epoch_us({ts}) % {w} * 2 = {w} "
        f"AND (epoch_us({ts}) // {w}) % 2 = 1) THEN (epoch_us({ts}) // {w} + 1) * {w} "
        f"ELSE (epoch_us({ts}) // {w}) * {w} END)"
    )


def _logs(run: str) -> str:
    from faultline.sources.tables import DEMO_SERVICES

    return f"""
    SELECT {run} AS run_id, event_id AS line_no, ts, {_pick(DEMO_SERVICES, 'user_id')} AS service_name,
      CASE WHEN event_type = 'error' AND value >= 150 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
           WHEN value >= 100 THEN 'WARNING' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
      event_type || ' by user ' || user_id || ' value ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)
        || CASE WHEN event_type = 'error' AND k % 3 = 0 THEN ' database timeout' ELSE '' END AS message,
      CAST(CASE WHEN event_type = 'error' AND k < 5 THEN 500 + k
                WHEN event_type = 'error' AND k < 20 THEN 404 ELSE 200 END AS INTEGER) AS status_code
    FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)"""


ERR = "level IN ('WARNING', 'ERROR', 'CRITICAL')"
OPEN = "status IN ('OPEN', 'INVESTIGATING')"


def _anomaly_ctes(prefix: str, z: float, minutes: int) -> dict[str, str]:
    """buckets -> stats -> anomalies over the CTE ``{prefix}logs``."""
    p = prefix
    return {
        f"{p}buckets": f"""
    SELECT run_id, service_name, {_round_bucket('ts', minutes)} AS bucket, count(message) AS total_logs,
      count(*) FILTER (WHERE {ERR}) AS error_count, count(*) FILTER (WHERE level = 'CRITICAL') AS critical_count,
      count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) AS status_5xx_count
    FROM {p}logs GROUP BY ALL""",
        f"{p}stats": f"""
    SELECT run_id, service_name, count(*) AS n_buckets, min(bucket) AS first_bucket, avg(error_count) AS mean_errors,
      stddev_pop(error_count) AS std_errors, avg(total_logs) AS mean_logs, stddev_pop(total_logs) AS std_logs
    FROM {p}buckets GROUP BY ALL""",
        f"{p}scored": f"""
    SELECT b.*, s.* EXCLUDE (run_id, service_name),
      CASE WHEN std_errors > 0 THEN round((error_count - mean_errors) / std_errors, 9) END AS z_errors,
      CASE WHEN std_logs > 0 THEN round((total_logs - mean_logs) / std_logs, 9) END AS z_logs
    FROM {p}buckets b JOIN {p}stats s ON b.run_id = s.run_id AND b.service_name = s.service_name""",
        f"{p}rules": f"""
    SELECT *, coalesce(z_errors > {z}, false) AS r1, coalesce(z_logs > {z} + 1, false) AS r2,
      critical_count > 0 AS r3, status_5xx_count > 0 AS r4 FROM {p}scored""",
        f"{p}anomalies": f"""
    SELECT *, bucket AS ts,
      greatest(CASE WHEN r1 THEN least(0.95, 0.4 + 0.15 * z_errors) ELSE 0 END,
               CASE WHEN r2 THEN least(0.90, 0.3 + 0.12 * z_logs) ELSE 0 END,
               CASE WHEN r3 THEN 0.85 ELSE 0 END, CASE WHEN r4 THEN 0.90 ELSE 0 END) AS confidence,
      concat_ws(',', CASE WHEN r1 THEN 'error_spike' END, CASE WHEN r2 THEN 'volume_spike' END,
                CASE WHEN r3 THEN 'critical' END, CASE WHEN r4 THEN 'http_5xx' END) AS reason_codes
    FROM {p}rules WHERE r1 OR r2 OR r3 OR r4""",
    }


def _root_ctes(p: str) -> dict[str, str]:
    from faultline.functions.fixed import INFRA_KEYWORDS

    return {
        f"{p}hints": f"""
    SELECT run_id, service_name, bool_or(level = 'CRITICAL') AS has_critical,
      bool_or(contains(lower(message), 'database') OR contains(lower(message), 'connection')) AS has_dep
    FROM {p}logs WHERE {ERR} GROUP BY ALL""",
        f"{p}first": f"""
    SELECT run_id, service_name, min(ts) AS first_ts, min(first_bucket) AS first_bucket
    FROM {p}anomalies GROUP BY ALL""",
        f"{p}scores": f"""
    SELECT f.*, later_services, CAST(
        CASE WHEN lag_s = 0 THEN 40 WHEN lag_s <= 60 THEN 25 WHEN lag_s <= 180 THEN 10 ELSE 0 END
        + CASE WHEN regexp_matches(lower(f.service_name), '{"|".join(INFRA_KEYWORDS)}') THEN 30 ELSE 0 END
        + later_services * 15 + CASE WHEN h.has_critical THEN 15 ELSE 0 END
        + CASE WHEN h.has_dep THEN 10 ELSE 0 END AS DOUBLE) AS score
    FROM (SELECT a.*, (SELECT count(*) FROM {p}first b WHERE b.run_id = a.run_id AND b.first_ts > a.first_ts)
            AS later_services,
            (epoch_us(first_ts) - epoch_us(min(first_ts) OVER (PARTITION BY run_id))) / 1000000.0 AS lag_s
          FROM {p}first a) f
    LEFT JOIN {p}hints h ON h.run_id = f.run_id AND h.service_name = f.service_name""",
        f"{p}ranked": f"""
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, first_ts, first_bucket, service_name) AS rk,
      row_number() OVER (PARTITION BY run_id ORDER BY first_ts, first_bucket, service_name) AS pos
    FROM {p}scores""",
        f"{p}roots": f"""
    SELECT run_id, max(CASE WHEN rk = 1 THEN service_name END) AS likely_root_cause,
      max(CASE WHEN rk = 1 THEN score END) AS score,
      round_even(least(0.98, greatest(0.30, max(CASE WHEN rk = 1 THEN score END) / 110.0)), 2) AS confidence,
      max(CASE WHEN pos = 1 THEN service_name END) AS first_service, min(first_ts) AS start_time, count(*) AS n_services,
      string_agg('`' || service_name || '`', ', ' ORDER BY pos) AS listed,
      string_agg(service_name, ',' ORDER BY service_name) AS affected
    FROM {p}ranked GROUP BY run_id""",
        f"{p}narrated": f"""
    SELECT *, CASE WHEN likely_root_cause = first_service THEN 'Incident began directly in the `' || likely_root_cause
      || '` service at ' || strftime(start_time, '%H:%M:%S') || '. Errors subsequently propagated to '
      || (n_services - 1) || ' other services: ' || listed || '.'
      ELSE 'Incident likely originated in the infrastructure layer `' || likely_root_cause || '`. Although `'
      || first_service || '` experienced the first symptom, upstream analysis points to `' || likely_root_cause
      || '` as the primary source of failure.' END AS summary FROM {p}roots""",
        f"{p}evidence": f"""
    SELECT a.run_id, a.ts, a.service_name, a.first_bucket, a.reason_codes, a.confidence,
      CASE WHEN r3 THEN 'CRITICAL' WHEN r1 OR r4 THEN 'ERROR' ELSE 'WARNING' END AS level,
      a.service_name = r.likely_root_cause AS is_root
    FROM {p}anomalies a JOIN {p}roots r ON a.run_id = r.run_id""",
        f"{p}timeline": f"""
    SELECT *, CASE WHEN is_root THEN 'root_cause_indicator' WHEN level IN ('ERROR', 'CRITICAL') THEN 'critical_error'
      ELSE 'anomaly' END AS event_type,
      CAST(CASE WHEN is_root THEN 5 WHEN level IN ('ERROR', 'CRITICAL') THEN 4 ELSE 3 END AS INTEGER) AS importance
    FROM {p}evidence""",
        f"{p}incidents": f"""
    SELECT n.run_id, CASE WHEN v.crit OR n_services >= 3 THEN 'CRITICAL' WHEN v.err OR n_services >= 2 THEN 'HIGH'
        WHEN v.warn THEN 'MEDIUM' ELSE 'LOW' END AS severity,
      n.start_time, n.affected, n.likely_root_cause AS root_cause, n.confidence, n.summary
    FROM {p}narrated n JOIN (SELECT run_id, bool_or(level = 'CRITICAL') AS crit, bool_or(level = 'ERROR') AS err,
      bool_or(level = 'WARNING') AS warn FROM {p}evidence GROUP BY run_id) v ON v.run_id = n.run_id""",
        f"{p}titled": f"""
    SELECT *, CASE severity WHEN 'CRITICAL' THEN 'Critical service degradation starting at '
        || strftime(start_time, '%H:%M') || ' due to ' || root_cause || ' failure'
      WHEN 'HIGH' THEN 'High-error spike in ' || root_cause || ' affecting downstream services'
      ELSE 'Multiple anomalies detected in ' || root_cause END AS title FROM {p}incidents""",
        f"{p}changes": f"""
    SELECT strftime(ts, '%Y-%m-%d') AS run_id, {_pick(['OPEN', 'INVESTIGATING', 'RESOLVED', 'CLOSED'], 'event_id')}
      AS status, ts AS changed_at, event_id AS change_id FROM events WHERE event_type = 'signup'""",
        f"{p}current": f"""
    SELECT t.*, coalesce(c.status, 'OPEN') AS status,
      CASE WHEN c.status IN ('RESOLVED', 'CLOSED') THEN c.changed_at END AS end_time
    FROM {p}titled t LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
      ORDER BY changed_at DESC, change_id DESC) AS rn FROM {p}changes) WHERE rn = 1) c ON c.run_id = t.run_id""",
    }


def _open_severity(current: str) -> str:
    return f"""
    SELECT service_name, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2
      WHEN 'LOW' THEN 1 ELSE 0 END) AS w
    FROM (SELECT severity, unnest(string_split(affected, ',')) AS service_name FROM {current} WHERE {OPEN})
    GROUP BY ALL"""


def _health(opensev: str) -> str:
    return f"""
    SELECT s.name, s.type, coalesce(r.error_rate, 0.0) AS error_rate, coalesce(h.n, 0) AS anomaly_count,
      CASE WHEN coalesce(r.error_rate, 0) >= 10 OR coalesce(o.w, 0) >= 3 THEN 'CRITICAL'
           WHEN coalesce(r.error_rate, 0) >= 2 OR coalesce(o.w, 0) >= 1 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status
    FROM services s LEFT JOIN rates r ON r.service_name = s.name LEFT JOIN {opensev} o ON o.service_name = s.name
    LEFT JOIN hourly h ON h.service_name = s.name"""


def _health_ctes() -> dict[str, str]:
    """Service health, and (``s_``) health after two status changes by hand on otherwise open incidents."""
    p = "d_"
    by_hand = "CASE run_id WHEN (SELECT min(run_id) FROM d_titled) THEN 'RESOLVED' WHEN (SELECT max(run_id) FROM d_titled) THEN 'INVESTIGATING' ELSE 'OPEN' END"
    db, gw, ext = "db|database|postgres|sql", "gateway|nginx", "external|stripe|twilio|aws"
    return {
        "clock": "SELECT max(ts) AS now FROM events",
        "services": f"""
    SELECT DISTINCT service_name AS name, CASE WHEN regexp_matches(lower(service_name), '{db}') THEN 'database'
      WHEN regexp_matches(lower(service_name), '{gw}') THEN 'gateway'
      WHEN regexp_matches(lower(service_name), '{ext}') THEN 'external' ELSE 'application' END AS type FROM {p}logs""",
        "rates": f"""
    SELECT service_name, count(*) AS total, count(*) FILTER (WHERE {ERR}) AS errors,
      round_even(count(*) FILTER (WHERE {ERR}) / count(*) * 100.0, 2) AS error_rate
    FROM {p}logs WHERE ts >= (SELECT now FROM clock) - INTERVAL 15 MINUTE GROUP BY ALL""",
        "s_current": f"""
    SELECT *, CASE WHEN status = 'RESOLVED' THEN (SELECT now FROM clock) END AS end_time FROM (SELECT *, {by_hand} AS status FROM {p}titled)""",
        "opensev": _open_severity(f"{p}current"),
        "s_opensev": _open_severity("s_current"),
        "hourly": f"""
    SELECT service_name, count(*) AS n FROM {p}timeline
    WHERE event_type = 'anomaly' AND ts >= (SELECT now FROM clock) - INTERVAL 1 HOUR GROUP BY ALL""",
        "health": _health("opensev"),
        "s_health": _health("s_opensev"),
    }


_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_MASKS = [
    ("<TIMESTAMP>", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"),
    ("<IP>", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("<UUID>", rf"\b{_UUID}\b"),
    ("<HEX>", r"\b0x[0-9a-fA-F]+\b"),
    ("<EMAIL>", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
]


def _mask_sql(column: str) -> str:
    """Message masks; numbers are masked per word run so that accented neighbours count as letters."""
    sql = column
    for mask, pattern in _MASKS:
        sql = f"regexp_replace({sql}, '{pattern}', '{mask}', 'g')"
    runs = f"regexp_extract_all({sql}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    masked = (
        f"array_to_string(list_transform({runs}, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') "
        "THEN '<NUM>' ELSE x END), '')"
    )
    return f"lower(trim(regexp_replace({masked}, '\\s+', ' ', 'g')))"


def _text_ctes() -> dict[str, str]:
    word = r"[\p{L}\p{N}_]+"
    return {
        "templates": f"SELECT doc_id, {_mask_sql('text')} AS template FROM documents",
        "tmpl": """
    SELECT template, count(*) AS n, min(doc_id) AS first_line FROM templates GROUP BY template""",
        "tf": f"""
    SELECT first_line, token, count(*) AS tf, any_value(n) AS n
    FROM (SELECT first_line, n, unnest(regexp_extract_all(template, '{word}')) AS token FROM tmpl) GROUP BY ALL""",
        "df": "SELECT token, sum(n) AS df FROM tf GROUP BY token",
        "raww": """
    SELECT tf.first_line, tf.token, tf.tf * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df.df)) + 1) AS w
    FROM tf JOIN df ON df.token = tf.token""",
        "weights": """
    SELECT first_line, token, w / sqrt(sum(w * w) OVER (PARTITION BY first_line)) AS weight FROM raww""",
        "pairs": """
    SELECT a.first_line AS i, b.first_line AS j, round(sum(a.weight * b.weight), 9) AS sim
    FROM weights a JOIN weights b ON a.token = b.token AND a.first_line < b.first_line
    GROUP BY ALL HAVING round(sum(a.weight * b.weight), 9) >= 0.75""",
    }


def _mix(x: str, t: str, y: str = "y") -> tuple[str, str]:
    """Two steps of the draw: first ``y``, then the number in [0, 2^31 - 1) from ``y``."""
    p = 2147483647
    first = f"({x} + 7919 * ({t} + 1)) % {p}"
    second = f"({y} * {y} % {p} * 48271 + {y}) % {p}"
    third = f"({second}) * ({second}) + 69621 * ({t} + 1)"
    fourth = f"((({third}) % {p}) * (({third}) % {p}) % {p} * 48271 + {x}) % {p}"
    return first, fourth


def _path(n: str) -> str:
    full = f"2.0::DOUBLE * (ln({n}::DOUBLE - 1) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1) / {n}"
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE {full} END"


def _forest_ctes() -> dict[str, str]:
    """A hundred trees of up to eight levels per service, grown and walked level by level, one expression each."""
    key, x = "run_id, service_name", "epoch(bucket)::BIGINT"
    first, draw = _mix(x, "tree")
    out = {
        "f_buckets": f"SELECT *, count(*) OVER (PARTITION BY {key}) AS n_all FROM buckets",
        "f_draws": f"""
    SELECT *, {draw} AS draw FROM (SELECT *, {first} AS y FROM f_buckets, (SELECT unnest(range(100)) AS tree) WHERE n_all >= 5)""",
        "f_points0": f"""
    SELECT {key}, tree, total_logs::DOUBLE AS x0, error_count::DOUBLE AS x1, error_count / (total_logs + 1e-5::DOUBLE) AS x2, 1::BIGINT AS node,
      least(n_all, 256) AS rows, ceil(log2(least(n_all, 256)))::INT AS most
    FROM (SELECT *, row_number() OVER (PARTITION BY {key}, tree ORDER BY draw, bucket) AS nth FROM f_draws) WHERE nth <= least(n_all, 256)""",
    }
    one, which = _mix("2 * node", "tree", "y1")
    two, where = _mix("(2 * node + 1)", "tree", "y2")
    for level in range(9):
        ranges = ", ".join(f"min(x{i}) AS l{i}, max(x{i}) AS h{i}" for i in range(3))
        pick = lambda side: "CASE pick " + " ".join(f"WHEN {i} THEN {side}{i}" for i in range(3)) + " END"
        out[f"f_nodes{level}"] = f"""
    SELECT *, lo + ({where})::DOUBLE / 2147483647.0::DOUBLE * (hi - lo) AS aim FROM (
      SELECT *, {pick('l')} AS lo, {pick('h')} AS hi FROM (
        SELECT *, CASE WHEN {level} < most AND len(differ) > 0 THEN differ[({which}) * len(differ) // 2147483647 + 1] END AS pick FROM (
          SELECT *, {one} AS y1, {two} AS y2,
            list_filter([CASE WHEN h0 > l0 THEN 0 END, CASE WHEN h1 > l1 THEN 1 END, CASE WHEN h2 > l2 THEN 2 END], lambda v: v IS NOT NULL) AS differ
          FROM (SELECT {key}, tree, node, count(*) AS size, any_value(most) AS most, {ranges} FROM f_points{level} GROUP BY ALL))))"""
        if level < 8:
            value = "CASE n.pick WHEN 0 THEN p.x0 WHEN 1 THEN p.x1 ELSE p.x2 END"
            out[f"f_points{level + 1}"] = f"""
    SELECT p.* REPLACE (2 * p.node + ({value} > CASE WHEN n.aim < n.hi THEN n.aim ELSE n.lo END)::BIGINT AS node)
    FROM f_points{level} p JOIN f_nodes{level} n USING ({key}, tree, node) WHERE n.pick IS NOT NULL"""
    out["f_nodes"] = " UNION ALL ".join(
        f"SELECT {key}, tree, node, pick, CASE WHEN aim < hi THEN aim ELSE lo END AS cut, {level} + ({_path('size')}) AS path FROM f_nodes{level}" for level in range(9)
    )
    out["f_walk0"] = f"""
    SELECT DISTINCT {key}, total_logs, error_count, error_count / (total_logs + 1e-5::DOUBLE) AS x2, least(n_all, 256) AS rows, tree, 1::BIGINT AS node
    FROM f_buckets, (SELECT unnest(range(100)) AS tree) WHERE n_all >= 5"""
    for level in range(8):
        value = "CASE n.pick WHEN 0 THEN w.total_logs::DOUBLE WHEN 1 THEN w.error_count::DOUBLE ELSE w.x2 END"
        out[f"f_walk{level + 1}"] = f"""
    SELECT w.* REPLACE (CASE WHEN n.pick IS NULL THEN w.node ELSE 2 * w.node + ({value} > n.cut)::BIGINT END AS node)
    FROM f_walk{level} w JOIN f_nodes n USING ({key}, tree, node)"""
    out["f_scores"] = f"""
    SELECT {key}, total_logs, error_count, round(pow(2.0::DOUBLE, -sum(n.path) / 100 / any_value({_path('w.rows')})) * 1000000000)::BIGINT AS score
    FROM f_walk8 w JOIN f_nodes n USING ({key}, tree, node) GROUP BY ALL"""
    out["f_outliers"] = f"""
    SELECT {key}, bucket FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score) - 1 AS nth,
        max(CASE WHEN place = nth0 THEN score END) OVER (PARTITION BY {key}) AS cut FROM (
      SELECT b.*, s.score, 9 * (n_all - 1) // 10 AS place, row_number() OVER (PARTITION BY {key} ORDER BY score) - 1 AS nth0
      FROM f_buckets b JOIN f_scores s USING ({key}, total_logs, error_count))) WHERE score > cut"""
    return {name: sql for name, sql in out.items()}


CTES: dict[str, str] = {
    "logs": _logs("'all'"),
    **_anomaly_ctes("", 2.0, 60),
    **_root_ctes(""),
    "d_logs": _logs("strftime(ts, '%Y-%m-%d')"),
    **_anomaly_ctes("d_", 2.0, 60),
    **_root_ctes("d_"),
    **_health_ctes(),
    **_forest_ctes(),
    **_text_ctes(),
}


def _needs(name: str) -> set[str]:
    """Names of the expressions that ``name`` mentions, with theirs."""
    import re

    found: set[str] = set()
    todo = [CTES[name]]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for other in CTES:
            if other in words and other not in found:
                found.add(other)
                todo.append(CTES[other])
    return found


def build(select: str) -> str:
    """``select`` with the expressions it needs, in definition order."""
    import re

    words = set(re.findall(r"\w+", select))
    wanted: set[str] = set()
    for name in CTES:
        if name in words:
            wanted |= {name} | _needs(name)
    if not wanted:
        return select
    body = ",\n".join(f"{name} AS {'MATERIALIZED ' if name.startswith('f_') else ''}({CTES[name]})" for name in CTES if name in wanted)
    return f"WITH RECURSIVE {body}\n{select}"
