"""SQL that computes what the registered queries should return, written relationally.

Each statement is a chain of common table expressions over the generated
tables; :func:`statement` keeps those that the final select needs.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def statement(select: str) -> str:
    """``select`` preceded by the expressions it refers to, directly or not."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"[a-z_][a-z_0-9]*", sql)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(select)
    chain = ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in CTES.items() if n in needed)
    return f"WITH {chain}\n{select.strip()}" if needed else select.strip()


# Fixed values here and below, which must equal the catalogue's and the texts' own: cat, segs, wordings,
# SHORT_PREFIXES, OUTREACH_BODY.

# -- catalogue ------------------------------------------------------------------

cte(
    "cat",
    """
SELECT * FROM (VALUES
  ('APPLICATION_DRAFTING', 0, 'Application Drafting', 0),
  ('RESEARCH', 1, 'Legal Research', 1),
  ('QUERY_ANSWER', 2, 'Query Answer', 2),
  ('SYNOPSIS_GENERATION', 3, 'Synopsis Generation', 0),
  ('DOCUMENT_EMBEDDING', 4, 'Document Embedding', 0)
) AS t(service, priority, label, cluster_id)
""",
)
cte(
    "segs",
    """
SELECT * FROM (VALUES
  (0, 'Heavy Draftsman', 'Power user of Application Drafting — high-frequency document creator'),
  (1, 'Heavy Researcher', 'Deep legal research user — case laws, judgments, and court updates'),
  (2, 'Query Analyst', 'Frequent Q&A user — legal definitions and quick lookups')
) AS t(cluster_id, label, description)
""",
)
cte(
    "wordings",
    """
SELECT * FROM (VALUES
  ('als', 'ALS collaborative filter'),
  ('peer', 'Popular with similar users'),
  ('global', 'Platform-wide trend'),
  ('usage', 'Grow lowest-usage service (full profile)')
) AS t(source, wording)
""",
)


def service_label(col: str, missing: str = "NULL") -> str:
    """Label of a service code: configured, else the code in title case."""
    titled = (
        f"array_to_string(list_transform(string_split(lower(replace({col}, '_', ' ')), ' '), "
        "lambda w: upper(w[1]) || substr(w, 2)), ' ')"
    )
    return (
        f"CASE WHEN {col} IS NULL OR {col} = '' THEN {missing} "
        f"ELSE coalesce((SELECT c.label FROM cat c WHERE c.service = {col}), {titled}) END"
    )


def segment_label(col: str) -> str:
    return (
        f"coalesce((SELECT s.label FROM segs s WHERE s.cluster_id = {col}), "
        f"'Cluster ' || CAST({col} AS VARCHAR))"
    )


# -- text -----------------------------------------------------------------------


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def without_prefix(x: str, prefixes: list[str]) -> str:
    whens = " ".join(
        f"WHEN starts_with({x}, '{p}') THEN substr({x}, {len(p) + 1})" for p in prefixes
    )
    return f"CASE {whens} ELSE {x} END"


SHORT_PREFIXES = ["Async Research: ", "Async Query: ", "Async Synopsis: ", "Async Draft: ", "Async "]


def title_short(x: str) -> str:
    return f"substr({without_prefix(strip(x), SHORT_PREFIXES)}, 1, 56)"


def title(x: str) -> str:
    rest = strip("(" + without_prefix(strip(x), [*SHORT_PREFIXES, "Conversation Record Turn"]) + ")")
    cut = rf"regexp_replace(substr({rest}, 1, 55), '\s+$', '') || '…'"
    return f"nullif(CASE WHEN length({rest}) > 56 THEN {cut} ELSE {rest} END, '')"


def valid_name(x: str) -> str:
    return f"CASE WHEN {strip(x)} NOT IN ('', 'nan', 'None') THEN {strip(x)} END"


def short_id(x: str) -> str:
    return f"substr({x}, 1, 8) || '…'"


def generic_name(x: str) -> str:
    return f"'User · ' || substr({x}, 1, 8) || '…'"


# -- event log --------------------------------------------------------------------

cte(
    "raw",
    """
SELECT event_id, user_id, event_type, ts, CAST(props ->> '$.k' AS INTEGER) AS k FROM events
""",
)
cte(
    "track",
    """
SELECT event_id,
  CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN k = 99 THEN 'legacy_export'
       WHEN event_type = 'purchase' THEN 'application_drafting'
       WHEN event_type = 'click' THEN 'Research'
       WHEN event_type = 'view' THEN 'QUERY_ANSWER'
       WHEN event_type = 'signup' THEN 'synopsis_generation'
       WHEN event_type = 'error' THEN 'DOCUMENT_EMBEDDING' END AS process_type,
  CASE WHEN k = 98 THEN NULL WHEN k < 5 THEN 'completed'
       WHEN k < 10 OR k = 99 THEN 'COMPLETED' ELSE 'failed' END AS status,
  CASE WHEN k % 11 = 0 THEN NULL
       WHEN event_type = 'click' THEN 'Async Research: item ' || event_id
       WHEN event_type = 'view' THEN 'Async Query: ' || repeat('long title ', 7) || event_id
       WHEN event_type = 'signup' THEN 'Conversation Record Turn ' || event_id
       ELSE ' Async job ' || event_id END AS process_name,
  ts AS created_at
FROM raw
""",
)
cte(
    "norm",
    """
SELECT event_id, user_id, upper(process_type) AS process_type, upper(status) AS status,
       process_name, created_at
FROM track
""",
)
cte(
    "done",
    """
SELECT * FROM norm WHERE status = 'COMPLETED' AND process_type IN (SELECT service FROM cat)
""",
)
cte(
    "refnames",
    """
SELECT CAST(c_custkey AS VARCHAR) AS user_id,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'nan'
       WHEN c_custkey % 13 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS ref_name
FROM customer
""",
)
cte(
    "cleannames",
    f"""
SELECT {strip('user_id')} AS name_key, max({valid_name('ref_name')}) AS ref_name
FROM refnames GROUP BY 1
""",
)

# -- uses -----------------------------------------------------------------------

cte(
    "aff",
    """
SELECT user_id, process_type, count(*) AS interaction_count FROM done GROUP BY 1, 2
""",
)
cte(
    "ranked_uses",
    """
SELECT a.*, c.priority,
  row_number() OVER (PARTITION BY user_id ORDER BY interaction_count DESC, priority, process_type) AS most,
  count(*) OVER (PARTITION BY user_id) AS services_used
FROM aff a JOIN cat c ON c.service = a.process_type
""",
)
cte(
    "act",
    "SELECT user_id, process_type AS active_service FROM ranked_uses WHERE most = 1",
)
cte(
    "allrank",
    """
SELECT process_type, total,
  row_number() OVER (ORDER BY total DESC, priority, process_type) AS global_rank
FROM (SELECT process_type, CAST(sum(interaction_count) AS BIGINT) AS total FROM aff GROUP BY 1)
JOIN cat ON service = process_type
""",
)
cte(
    "peers",
    """
SELECT active_service, process_type, peer_total,
  row_number() OVER (PARTITION BY active_service ORDER BY peer_total DESC, priority, process_type) AS peer_rank
FROM (SELECT active_service, process_type, CAST(sum(interaction_count) AS BIGINT) AS peer_total
      FROM aff JOIN act USING (user_id) GROUP BY 1, 2)
JOIN cat ON service = process_type
""",
)
cte(
    "scored",
    """
SELECT user_id, service AS process_type, priority,
  ((CAST(user_id AS BIGINT) * 31 + priority * priority * 17) % 5) / 5.0::DOUBLE AS score
FROM act CROSS JOIN cat
""",
)
cte(
    "scored_gaps",
    """
SELECT s.* FROM scored s
WHERE NOT EXISTS (SELECT 1 FROM aff a WHERE a.user_id = s.user_id AND a.process_type = s.process_type)
""",
)
cte(
    "top_two",
    """
SELECT * FROM (
  SELECT user_id, process_type, score,
    row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, priority, process_type) AS rank
  FROM scored_gaps)
WHERE rank <= 2
""",
)
cte(
    "model_slots",
    """
SELECT a.user_id, a.active_service,
  t1.process_type AS cross_recommend_1, t1.score AS rec1_score,
  t2.process_type AS cross_recommend_2, t2.score AS rec2_score
FROM act a
LEFT JOIN top_two t1 ON t1.user_id = a.user_id AND t1.rank = 1
LEFT JOIN top_two t2 ON t2.user_id = a.user_id AND t2.rank = 2
""",
)
cte(
    "no_slots",
    """
SELECT user_id, active_service,
  CAST(NULL AS VARCHAR) AS cross_recommend_1, CAST(NULL AS DOUBLE) AS rec1_score,
  CAST(NULL AS VARCHAR) AS cross_recommend_2, CAST(NULL AS DOUBLE) AS rec2_score
FROM act
""",
)
cte(
    "thresholds",
    """
SELECT process_type, quantile_disc(interaction_count, 0.25) AS gap_threshold FROM aff GROUP BY 1
""",
)
cte(
    "growth",
    """
SELECT user_id, active_service,
  max(CASE WHEN least_rank = 1 THEN process_type END) AS growth_1,
  max(CASE WHEN least_rank = 2 THEN process_type END) AS growth_2
FROM (
  SELECT r.user_id, a.active_service, r.process_type,
    row_number() OVER (PARTITION BY r.user_id
                       ORDER BY r.interaction_count, r.priority, r.process_type) AS least_rank
  FROM ranked_uses r JOIN act a USING (user_id)
  WHERE r.services_used >= 5 AND r.process_type <> a.active_service)
GROUP BY 1, 2
""",
)


def fill_ctes(name: str, slots: str) -> None:
    """Batch fill over a table of slots: users by candidate services, ranked."""
    cte(
        f"{name}_cand",
        f"""
SELECT s.user_id, g.process_type, p.peer_rank,
  row_number() OVER (PARTITION BY s.user_id ORDER BY p.peer_rank NULLS LAST, g.global_rank) AS pick
FROM {slots} s CROSS JOIN allrank g
LEFT JOIN peers p ON p.active_service = s.active_service AND p.process_type = g.process_type
WHERE NOT EXISTS (SELECT 1 FROM aff a WHERE a.user_id = s.user_id AND a.process_type = g.process_type)
  AND g.process_type IS DISTINCT FROM s.cross_recommend_1
  AND g.process_type IS DISTINCT FROM s.cross_recommend_2
""",
    )
    cte(
        f"{name}_picked",
        f"""
SELECT s.user_id, s.active_service, s.cross_recommend_1 AS m1, s.cross_recommend_2 AS m2,
  c1.process_type AS p1, c1.peer_rank AS r1, c2.process_type AS p2, c2.peer_rank AS r2,
  w.growth_1, w.growth_2
FROM {slots} s
LEFT JOIN {name}_cand c1 ON c1.user_id = s.user_id AND s.cross_recommend_1 IS NULL AND c1.pick = 1
LEFT JOIN {name}_cand c2 ON c2.user_id = s.user_id AND s.cross_recommend_2 IS NULL
  AND c2.pick = CASE WHEN s.cross_recommend_1 IS NULL THEN 2 ELSE 1 END
LEFT JOIN growth w ON w.user_id = s.user_id AND s.cross_recommend_1 IS NULL AND c1.process_type IS NULL
""",
    )
    cte(
        name,
        f"""
SELECT f.user_id, c.cluster_id, f.active_service,
  coalesce(growth_1, m1, p1) AS cross_recommend_1,
  CASE WHEN growth_1 IS NOT NULL THEN 65.0 WHEN m1 IS NOT NULL THEN 88.0
       WHEN p1 IS NOT NULL THEN 72.0 END::DOUBLE AS rec1_score,
  CASE WHEN growth_1 IS NOT NULL THEN 'usage' WHEN m1 IS NOT NULL THEN 'als'
       WHEN p1 IS NULL THEN NULL WHEN r1 <= 4 THEN 'peer' ELSE 'global' END AS rec1_source,
  CASE WHEN growth_1 IS NOT NULL THEN growth_2 ELSE coalesce(m2, p2) END AS cross_recommend_2,
  CASE WHEN growth_1 IS NOT NULL THEN CASE WHEN growth_2 IS NOT NULL THEN 52.0 END
       WHEN m2 IS NOT NULL OR p2 IS NOT NULL THEN 58.0 END::DOUBLE AS rec2_score,
  CASE WHEN growth_1 IS NOT NULL THEN CASE WHEN growth_2 IS NOT NULL THEN 'usage' END
       WHEN m2 IS NOT NULL THEN 'als' WHEN p2 IS NULL THEN NULL
       WHEN r2 <= 4 THEN 'peer' ELSE 'global' END AS rec2_source
FROM {name}_picked f JOIN cat c ON c.service = f.active_service
""",
    )


cte(
    "pct_gaps",
    """
SELECT s.* FROM scored s
WHERE NOT EXISTS (SELECT 1 FROM aff a JOIN thresholds t USING (process_type)
  WHERE a.user_id = s.user_id AND a.process_type = s.process_type AND a.interaction_count > t.gap_threshold)
""",
)
cte(
    "pct_two",
    """
SELECT * FROM (
  SELECT user_id, process_type, score,
    row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, priority, process_type) AS rank
  FROM pct_gaps)
WHERE rank <= 2
""",
)
cte(
    "pct_slots",
    """
SELECT a.user_id, a.active_service,
  t1.process_type AS cross_recommend_1, t1.score AS rec1_score,
  t2.process_type AS cross_recommend_2, t2.score AS rec2_score
FROM act a
LEFT JOIN pct_two t1 ON t1.user_id = a.user_id AND t1.rank = 1
LEFT JOIN pct_two t2 ON t2.user_id = a.user_id AND t2.rank = 2
""",
)

fill_ctes("filled", "model_slots")
fill_ctes("filled_pct", "pct_slots")
fill_ctes("filled_plain", "no_slots")

cte("lastact", "SELECT user_id, max(created_at) AS last_active_at FROM done GROUP BY 1")
cte(
    "firstname",
    """
SELECT u.user_id, f.process_name
FROM (SELECT DISTINCT user_id FROM track) u
LEFT JOIN (
  SELECT user_id, process_name FROM (
    SELECT user_id, process_name,
      row_number() OVER (PARTITION BY user_id ORDER BY created_at NULLS LAST, event_id) AS rn
    FROM track WHERE process_name IS NOT NULL) WHERE rn = 1
) f USING (user_id)
""",
)
cte(
    "hints",
    f"""
SELECT user_id, hint FROM (
  SELECT user_id, {title('process_name')} AS hint,
    row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, event_id DESC) AS rn
  FROM norm WHERE status = 'COMPLETED')
WHERE rn = 1 AND hint IS NOT NULL
""",
)


def user_clusters_cte(name: str, filled: str) -> None:
    cte(
        name,
        f"""
SELECT f.user_id, n.ref_name AS "Name", f.cluster_id, f.active_service,
  f.cross_recommend_1, f.rec1_score, f.rec1_source,
  f.cross_recommend_2, f.rec2_score, f.rec2_source,
  coalesce(nullif({title_short('p.process_name')}, ''), {generic_name('f.user_id')}) AS user_display_name,
  {service_label('f.active_service')} AS active_service_name,
  {service_label('f.cross_recommend_1')} AS rec1_name,
  {service_label('f.cross_recommend_2')} AS rec2_name,
  {segment_label('f.cluster_id')} AS segment_name,
  l.last_active_at, p.process_name
FROM {filled} f
LEFT JOIN cleannames n ON n.name_key = {strip('f.user_id')}
LEFT JOIN lastact l ON l.user_id = f.user_id
LEFT JOIN firstname p ON p.user_id = f.user_id
""",
    )


user_clusters_cte("uc", "filled")
user_clusters_cte("uc_plain", "filled_plain")
user_clusters_cte("uc_pct", "filled_pct")

# -- repair pass -----------------------------------------------------------------

cte("stored_full", "SELECT * FROM uc")
cte(
    "stored_empty",
    """
SELECT a.user_id, c.cluster_id, a.active_service,
  CAST(NULL AS VARCHAR) AS cross_recommend_1, CAST(NULL AS DOUBLE) AS rec1_score,
  CAST(NULL AS VARCHAR) AS rec1_source,
  CAST(NULL AS VARCHAR) AS cross_recommend_2, CAST(NULL AS DOUBLE) AS rec2_score,
  CAST(NULL AS VARCHAR) AS rec2_source, CAST(NULL AS VARCHAR) AS rec1_name
FROM act a JOIN cat c ON c.service = a.active_service
""",
)


def enrich_ctes(name: str, stored: str) -> None:
    """Repair of a stored table: slot 1, slot 2, growth, last resort, one step at a time."""
    unused = (
        "NOT EXISTS (SELECT 1 FROM aff a WHERE a.user_id = s.user_id "
        "AND a.process_type = g.process_type)"
    )
    cte(
        f"{name}_one",
        f"""
SELECT s.user_id, s.active_service, s.cross_recommend_1 AS had1, s.cross_recommend_2 AS had2,
  coalesce(s.cross_recommend_1, arg_min(g.process_type, g.peer_rank)) AS one,
  min(g.peer_rank) AS one_rank
FROM {stored} s
LEFT JOIN peers g ON s.cross_recommend_1 IS NULL AND g.active_service = s.active_service
  AND {unused} AND g.process_type IS DISTINCT FROM s.cross_recommend_2
GROUP BY s.user_id, s.active_service, s.cross_recommend_1, s.cross_recommend_2
""",
    )
    cte(
        f"{name}_cand",
        f"""
SELECT s.user_id, g.process_type, p.peer_rank,
  row_number() OVER (PARTITION BY s.user_id ORDER BY p.peer_rank NULLS LAST, g.global_rank) AS pick
FROM {name}_one s CROSS JOIN allrank g
LEFT JOIN peers p ON p.active_service = s.active_service AND p.process_type = g.process_type
WHERE s.had2 IS NULL AND {unused} AND g.process_type IS DISTINCT FROM s.one
""",
    )
    cte(
        f"{name}_two",
        f"""
SELECT s.*, w.growth_1, w.growth_2,
  CASE WHEN w.growth_1 IS NOT NULL THEN w.growth_1 ELSE s.one END AS new1,
  CASE WHEN w.growth_1 IS NOT NULL THEN w.growth_2 ELSE coalesce(s.had2, c.process_type) END AS new2,
  c.process_type AS two, c.peer_rank AS two_rank
FROM {name}_one s
LEFT JOIN {name}_cand c ON c.user_id = s.user_id AND c.pick = 1
LEFT JOIN growth w ON w.user_id = s.user_id AND s.one IS NULL
""",
    )
    cte(
        f"{name}_last",
        f"""
SELECT s.user_id, arg_min(g.process_type, g.global_rank) AS resort
FROM {name}_two s JOIN allrank g
  ON g.process_type IS DISTINCT FROM s.new1 AND g.process_type IS DISTINCT FROM s.active_service
WHERE s.new2 IS NULL GROUP BY 1
""",
    )
    cte(
        name,
        f"""
SELECT s.user_id, t.new1 AS cross_recommend_1,
  CASE WHEN t.growth_1 IS NOT NULL THEN 65.0
       WHEN t.had1 IS NULL AND t.one IS NOT NULL THEN 72.0 ELSE s.rec1_score END::DOUBLE AS rec1_score,
  CASE WHEN t.growth_1 IS NOT NULL THEN 'usage'
       WHEN t.had1 IS NULL AND t.one IS NOT NULL
         THEN CASE WHEN t.one_rank <= 3 THEN 'peer' ELSE 'global' END
       ELSE s.rec1_source END AS rec1_source,
  coalesce(t.new2, l.resort) AS cross_recommend_2,
  CASE WHEN t.new2 IS NULL AND l.resort IS NOT NULL THEN 50.0
       WHEN t.growth_1 IS NOT NULL THEN 52.0
       WHEN t.had2 IS NULL AND t.two IS NOT NULL THEN 58.0 ELSE s.rec2_score END::DOUBLE AS rec2_score,
  CASE WHEN t.new2 IS NULL AND l.resort IS NOT NULL THEN 'global'
       WHEN t.growth_1 IS NOT NULL THEN 'usage'
       WHEN t.had2 IS NULL AND t.two IS NOT NULL
         THEN CASE WHEN t.two_rank <= 5 THEN 'peer' ELSE 'global' END
       ELSE s.rec2_source END AS rec2_source
FROM {stored} s JOIN {name}_two t ON t.user_id = s.user_id
LEFT JOIN {name}_last l ON l.user_id = s.user_id
""",
    )


enrich_ctes("enr", "stored_full")
enrich_ctes("enr_empty", "stored_empty")

# -- numbering and fixed factors -----------------------------------------------------

cte(
    "numbered",
    """
SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_idx
FROM (SELECT DISTINCT user_id FROM aff)
""",
)
cte(
    "fixed",
    """
SELECT user_idx, CAST(i AS INTEGER) AS process_idx,
  (user_idx * 7 % 11) / 8.0::DOUBLE * ((i + 1) / 2.0::DOUBLE)
    + (user_idx * 3 % 5) / 4.0::DOUBLE * ((i * i % 3) / 4.0::DOUBLE) AS score
FROM numbered, range(6) AS t(i)
""",
)

# -- reports ---------------------------------------------------------------------

cte(
    "gapped",
    """
SELECT a.user_id, c.priority AS position, c.service AS process_type,
  NOT EXISTS (SELECT 1 FROM aff x WHERE x.user_id = a.user_id AND x.process_type = c.service) AS is_gap
FROM act a CROSS JOIN cat c
""",
)
cte(
    "profiled",
    f"""
SELECT user_id, coalesce("Name", {short_id('user_id')}) AS display_name, cluster_id, segment_name,
  active_service, active_service_name, cross_recommend_1, rec1_name, rec1_score,
  coalesce(rec1_source, 'als') AS rec1_source, cross_recommend_2, rec2_name, rec2_score,
  coalesce(rec2_source, 'als') AS rec2_source, last_active_at
FROM uc
""",
)
cte(
    "viewed",
    f"""
SELECT coalesce("Name", {short_id('user_id')}) AS "User", user_id AS "User ID",
  segment_name AS "Segment", cluster_id AS "Cluster", active_service_name AS "Active Service",
  coalesce(rec1_name, '') AS "Primary Recommendation",
  coalesce(CAST(CAST(round_even(rec1_score, 0) AS BIGINT) AS VARCHAR), '') AS "Primary Fit Score",
  coalesce(upper(rec1_source[1]) || substr(rec1_source, 2), '') AS "Primary Source",
  coalesce(rec2_name, '') AS "Secondary Recommendation",
  coalesce(CAST(CAST(round_even(rec2_score, 0) AS BIGINT) AS VARCHAR), '') AS "Secondary Fit Score",
  coalesce(upper(rec2_source[1]) || substr(rec2_source, 2), '') AS "Secondary Source",
  last_active_at AS "Last Active"
FROM uc
""",
)
cte(
    "cards",
    """
SELECT user_id, 1 AS rank, cross_recommend_1 AS service, rec1_name AS label, rec1_score AS score,
  rec1_source AS source FROM uc WHERE cross_recommend_1 <> ''
UNION ALL
SELECT user_id, 2, cross_recommend_2, rec2_name, rec2_score, rec2_source
FROM uc WHERE cross_recommend_2 <> ''
""",
)

MART_COLUMNS = {
    "user_clusters": (
        "uc",
        "user_id string,Name string,cluster_id int,active_service string,cross_recommend_1 string,"
        "rec1_score double,rec1_source string,cross_recommend_2 string,rec2_score double,"
        "rec2_source string,user_display_name string,active_service_name string,rec1_name string,"
        "rec2_name string,segment_name string,last_active_at timestamp_ntz,process_name string",
    ),
    "user_activity": (
        "done",
        "event_id bigint,user_id string,process_type string,status string,process_name string,"
        "created_at timestamp_ntz",
    ),
    "user_service_stats": ("aff", "user_id string,process_type string,interaction_count bigint"),
}


def table_profile_sql() -> str:
    parts = []
    for table, (source, columns) in MART_COLUMNS.items():
        rows = ", ".join(
            f"({n}, '{spec.split()[0]}', '{spec.split()[1]}')"
            for n, spec in enumerate(columns.split(","), 1)
        )
        parts.append(
            f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {source}) AS row_count, "
            f"position, column_name, column_type "
            f"FROM (VALUES {rows}) AS t(position, column_name, column_type)"
        )
    return "\nUNION ALL\n".join(parts)


UC_COLUMNS = (
    'user_id, "Name", cluster_id, active_service, cross_recommend_1, rec1_score, rec1_source, '
    "cross_recommend_2, rec2_score, rec2_source, user_display_name, active_service_name, "
    "rec1_name, rec2_name, segment_name, last_active_at, process_name"
)

COVERAGE = (
    "CASE WHEN count(*) = 0 THEN 0 ELSE CAST(round_even(100.0 * "
    "count(*) FILTER (WHERE trim(cross_recommend_1) <> '') / count(*), 0) AS BIGINT) END"
)

OUTREACH_BODY = """
'Dear ' || display_name || ',' || chr(10) || chr(10) ||
'We noticed you''ve been actively using our ' || active_service_name || ' service on Gapwise. ' ||
'To streamline your workflow even further, we highly recommend trying out ' || rec1_name || '.' ||
chr(10) || chr(10) ||
'Based on your service usage profile, similar practitioners who use ' || active_service_name ||
' found ' || rec1_name || ' to be extremely valuable for their practice.' || chr(10) || chr(10) ||
'Try ' || rec1_name || ' today: https://example.com/services/' || lower(cross_recommend_1) ||
chr(10) || chr(10) || 'Best regards,' || chr(10) || 'The Gapwise Team'
"""

FINAL: dict[str, str] = {
    "read_tracking": "SELECT * FROM track",
    "pick_timestamp": "SELECT event_id, created_at FROM track",
    "read_marts": """
SELECT uc.user_id, uc.cluster_id, uc.active_service, aff.process_type, aff.interaction_count
FROM uc JOIN aff ON aff.user_id = uc.user_id""",
    "write_marts": f"SELECT {UC_COLUMNS} FROM uc",
    "export_csv": "SELECT * FROM viewed",
    "export_json": "SELECT * FROM viewed",
    "normalize_events": "SELECT * FROM norm",
    "completed_core": "SELECT * FROM done",
    "normalization_audit": """
SELECT (SELECT count(*) FROM track) AS raw_rows, (SELECT count(*) FROM done) AS completed_core_rows,
  (SELECT count(*) FROM track WHERE status = 'COMPLETED') AS strict_status_rows""",
    "user_activity": """
SELECT event_id, user_id, process_type, status, process_name, created_at FROM done""",
    "valid_user_ids": """
SELECT user_id, external_id FROM (
  SELECT user_id, CASE WHEN CAST(user_id AS BIGINT) % 3 = 0 THEN substr(full_id, 1, 8) ELSE full_id END AS external_id
  FROM (SELECT user_id, concat_ws('-', substr(md5(user_id), 1, 8), substr(md5(user_id), 9, 4),
          substr(md5(user_id), 13, 4), substr(md5(user_id), 17, 4), substr(md5(user_id), 21, 12)) AS full_id
        FROM (SELECT DISTINCT user_id FROM track)))
WHERE regexp_full_match(lower(external_id), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')""",
    "explorer_filter": f"""
SELECT {UC_COLUMNS} FROM uc
WHERE cluster_id IN (0, 1, 2)
  AND (active_service IN ('APPLICATION_DRAFTING', 'RESEARCH', 'QUERY_ANSWER') OR active_service IS NULL)
  AND (contains(lower(user_id), 'customer#') OR coalesce(contains(lower("Name"), 'customer#'), false))""",
    "indexed_search": f"""
SELECT {UC_COLUMNS} FROM uc
WHERE cluster_id IN (0, 1, 2)
  AND (active_service IN ('APPLICATION_DRAFTING', 'RESEARCH', 'QUERY_ANSWER') OR active_service IS NULL)
  AND (contains(lower(user_id), 'customer#') OR coalesce(contains(lower("Name"), 'customer#'), false))""",
    "explorer_view": "SELECT * FROM viewed",
    "affinity": "SELECT * FROM aff",
    "user_service_stats": "SELECT user_id, process_type, interaction_count FROM aff",
    "affinity_summary": """
SELECT count(DISTINCT user_id) AS users, count(DISTINCT process_type) AS services FROM aff""",
    "service_totals": """
SELECT process_type, CAST(sum(interaction_count) AS BIGINT) AS total FROM aff GROUP BY 1
ORDER BY total DESC, process_type""",
    "usage_matrix": "SELECT user_id, "
    + ", ".join(
        f"CAST(coalesce(sum(interaction_count) FILTER (WHERE process_type = '{s}'), 0) AS BIGINT) AS \"{s}\""
        for s in (
            "APPLICATION_DRAFTING",
            "RESEARCH",
            "QUERY_ANSWER",
            "SYNOPSIS_GENERATION",
            "DOCUMENT_EMBEDDING",
        )
    )
    + " FROM aff GROUP BY user_id",
    "gap_thresholds": "SELECT * FROM thresholds",
    "last_active": "SELECT * FROM lastact",
    "merged_affinity": "SELECT * FROM aff",
    "merged_last_active": "SELECT * FROM lastact",
    "pass_through_first": "SELECT user_id, process_name FROM firstname",
    "latest_activity_hint": "SELECT user_id, hint FROM hints",
    "used_services": "SELECT DISTINCT user_id, process_type FROM aff",
    "cluster_dist": "SELECT cluster_id, count(*) AS users FROM uc GROUP BY 1 ORDER BY 1",
    "service_by_cluster": """
SELECT cluster_id, active_service, count(*) AS users FROM uc
WHERE active_service IS NOT NULL GROUP BY 1, 2""",
    "rec_frequency": """
SELECT cross_recommend_1 AS service, count(*) AS users FROM uc
WHERE cross_recommend_1 IS NOT NULL GROUP BY 1 ORDER BY users DESC, service""",
    "rec_coverage_pct": f"SELECT {COVERAGE} AS coverage_pct FROM uc",
    "platform_kpis": f"""
SELECT (SELECT count(*) FROM uc) AS total_users, (SELECT count(DISTINCT cluster_id) FROM uc) AS clusters,
  (SELECT count(*) FROM done) AS total_events, (SELECT {COVERAGE} FROM uc) AS coverage_pct""",
    "cluster_summary": """
SELECT k.cluster_id, coalesce(s.label, '—') AS segment, k.users,
  coalesce((SELECT v.active_service FROM
     (SELECT active_service, count(*) AS n FROM uc WHERE cluster_id = k.cluster_id GROUP BY 1) v
     JOIN cat c ON c.service = v.active_service ORDER BY v.n DESC, c.priority LIMIT 1), '—') AS top_active_service,
  coalesce((SELECT v.cross_recommend_1 FROM
     (SELECT cross_recommend_1, count(*) AS n FROM uc WHERE cluster_id = k.cluster_id GROUP BY 1) v
     JOIN cat c ON c.service = v.cross_recommend_1 ORDER BY v.n DESC, c.priority LIMIT 1), '—') AS top_recommendation
FROM (SELECT cluster_id, count(user_id) AS users FROM uc GROUP BY 1) k
LEFT JOIN segs s ON s.cluster_id = k.cluster_id""",
    "rec_sources": "SELECT rec1_source, count(*) AS users FROM uc GROUP BY 1 ORDER BY users DESC, rec1_source",
    "active_service": "SELECT * FROM act",
    "global_rank": "SELECT process_type, total, CAST(global_rank AS INTEGER) AS global_rank FROM allrank",
    "peer_rank": """
SELECT active_service, process_type, peer_total, CAST(peer_rank AS INTEGER) AS peer_rank FROM peers""",
    "topn_per_user": "SELECT user_id, process_type, score, CAST(rank AS INTEGER) AS rank FROM top_two",
    "spread_ranks": "SELECT * FROM model_slots",
    "top_users": f"""
SELECT uc.user_id, coalesce(uc."Name", {short_id('uc.user_id')}) AS user_label, uc.cluster_id,
  {segment_label('uc.cluster_id')} AS segment, uc.active_service,
  {service_label('uc.active_service', "'Unknown'")} AS service, t.total_actions
FROM uc JOIN (SELECT user_id, CAST(sum(interaction_count) AS BIGINT) AS total_actions FROM aff GROUP BY 1) t
  ON t.user_id = uc.user_id
ORDER BY t.total_actions DESC, uc.user_id LIMIT 20""",
    "user_stats": """
SELECT user_id, process_type, interaction_count FROM aff
ORDER BY user_id, interaction_count DESC, process_type""",
    "recent_activity": """
SELECT event_id, user_id, process_type, status, process_name, created_at, CAST(position AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY created_at DESC NULLS LAST, event_id DESC) AS position FROM done)
WHERE position <= 20""",
    "all_activity": """
SELECT event_id, user_id, process_type, status, process_name, created_at,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, event_id DESC) AS INTEGER) AS position
FROM done""",
    "users_by_cluster": 'SELECT user_id, "Name" FROM uc WHERE cluster_id = 0 ORDER BY user_id',
    "lookup_user": f"SELECT {UC_COLUMNS} FROM uc WHERE user_id = trim(' 7 ')",
    "adopted_services": """
SELECT a.user_id, a.process_type FROM aff a JOIN thresholds t USING (process_type)
WHERE a.interaction_count > t.gap_threshold""",
    "gap_candidates": "SELECT user_id, process_type, score FROM scored_gaps",
    "missing_users": "SELECT * FROM model_slots",
    "profile_gaps": "SELECT * FROM gapped",
    "restore_names": f"""
SELECT a.user_id, a.active_service, n.ref_name AS "Name"
FROM act a LEFT JOIN cleannames n ON n.name_key = {strip('a.user_id')}""",
    "attach_activity_names": """
SELECT d.user_id, d.process_type, d.status, d.created_at,
  coalesce(d.process_name, n.process_name) AS process_name, min(d.event_id) AS event_id
FROM done d LEFT JOIN (
  SELECT user_id, process_type, created_at, process_name,
    row_number() OVER (PARTITION BY user_id, process_type, created_at ORDER BY event_id) AS rn
  FROM norm WHERE status = 'COMPLETED') n
ON n.rn = 1 AND n.user_id IS NOT DISTINCT FROM d.user_id
  AND n.process_type IS NOT DISTINCT FROM d.process_type
  AND n.created_at IS NOT DISTINCT FROM d.created_at
GROUP BY ALL""",
    "label_join": f"""
SELECT x.event_id, x.process_type, x.cluster_id,
  {service_label('x.process_type', "'Unknown'")} AS process_type_label,
  {segment_label('x.cluster_id')} AS segment_label
FROM (SELECT n.event_id, n.process_type, coalesce(c.cluster_id, 0) AS cluster_id
      FROM norm n LEFT JOIN cat c ON c.service = n.process_type) x""",
    "user_directory": f"""
SELECT user_id, coalesce("Name", {short_id('user_id')}) AS user_label, "Name" IS NOT NULL AS has_name FROM uc""",
    "segment_directory": """
SELECT coalesce(s.cluster_id, u.cluster_id) AS cluster_id,
  coalesce(s.label, 'Cluster ' || u.cluster_id) AS label, s.description, coalesce(u.users, 0) AS users
FROM segs s FULL OUTER JOIN (SELECT cluster_id, count(*) AS users FROM uc GROUP BY 1) u
  ON u.cluster_id = s.cluster_id""",
    "dense_index": "SELECT * FROM numbered",
    "extended_index": """
SELECT user_id, row_number() OVER (ORDER BY CAST(user_id AS BIGINT) % 2, user_id) - 1 AS user_idx
FROM (SELECT DISTINCT user_id FROM aff)""",
    "score_all": """
SELECT user_idx, process_idx, CAST(score AS FLOAT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, process_idx DESC) AS best
  FROM fixed WHERE process_idx < 5)
WHERE best <= 3""",
    "decode_index": """
SELECT coalesce(n.user_id, 'UNKNOWN') AS user_id, coalesce(c.service, 'UNKNOWN') AS process_type, f.score
FROM fixed f LEFT JOIN numbered n ON n.user_idx = f.user_idx + 1 LEFT JOIN cat c ON c.priority = f.process_idx""",
    "fit_als": """
SELECT count(*) AS users, 5::BIGINT AS services, 10 AS rank, 0::BIGINT AS bad_values, 5 * count(*) AS pairs,
  true AS lowers_loss FROM act""",
    "k_sweep": """
SELECT 2 AS k_min, CAST(least(8, count(*) - 1) AS INTEGER) AS k_max, least(8, count(*) - 1) - 1 AS tried,
  least(8, count(*) - 1) - 1 AS possible, 1::BIGINT AS best FROM act""",
    "kmeans_segments": """
SELECT count(*) AS rows, count(*) AS users, 3::BIGINT AS segments, 0::BIGINT AS without FROM act""",
    "build_user_clusters_als": """
SELECT count(*) AS users, count(*) FILTER (WHERE n < 5) AS from_model, count(*) FILTER (WHERE n = 5) AS full_profiles,
  count(*) FILTER (WHERE n = 4) AS one_gap, 0::BIGINT AS broken
FROM (SELECT user_id, count(*) AS n FROM aff GROUP BY 1)""",
    "sample_users": f"""
SELECT {UC_COLUMNS} FROM uc ORDER BY md5(user_id || ':42'), user_id LIMIT 20""",
    "reordered_log": f"""
SELECT u.user_id, u.events, u.newest, f.process_name, h.hint
FROM (SELECT user_id, count(*) AS events, max(created_at) AS newest FROM norm GROUP BY 1) u
JOIN (SELECT user_id, arg_min(process_name, (created_at, process_type, process_name)) AS process_name
      FROM norm GROUP BY 1) f USING (user_id)
LEFT JOIN (
  SELECT user_id, {title('process_name')} AS hint FROM (
    SELECT user_id, process_name, row_number() OVER (PARTITION BY user_id
      ORDER BY created_at DESC, process_type DESC, process_name DESC NULLS LAST) AS rn
    FROM norm WHERE status = 'COMPLETED') WHERE rn = 1) h USING (user_id)""",
    "assign_segment": """
SELECT a.user_id, a.active_service, coalesce(c.cluster_id, 0) AS cluster_id
FROM act a LEFT JOIN cat c ON c.service = a.active_service""",
    "fill_gaps": "SELECT * FROM filled",
    "fill_gaps_no_model": "SELECT * FROM filled_plain",
    "usage_growth": "SELECT * FROM growth",
    "enrich_recs": """
SELECT u.user_id, u."Name", u.cluster_id, u.active_service, e.cross_recommend_1, e.rec1_score, e.rec1_source,
  e.cross_recommend_2, e.rec2_score, e.rec2_source, u.user_display_name, u.active_service_name,
  u.rec1_name, u.rec2_name, u.segment_name, u.last_active_at, u.process_name
FROM uc u JOIN enr e ON e.user_id = u.user_id""",
    "enrich_recs_empty": """
SELECT s.user_id, s.cluster_id, s.active_service, e.cross_recommend_1, e.rec1_score, e.rec1_source,
  e.cross_recommend_2, e.rec2_score, e.rec2_source, s.rec1_name
FROM stored_empty s JOIN enr_empty e ON e.user_id = s.user_id""",
    "enrich_user_clusters": f"""
SELECT u.user_id, u."Name", u.cluster_id, u.active_service, e.cross_recommend_1, e.rec1_score, e.rec1_source,
  e.cross_recommend_2, e.rec2_score, e.rec2_source,
  coalesce(h.hint, {generic_name('u.user_id')}) AS user_display_name, u.active_service_name,
  {service_label('e.cross_recommend_1', "'—'")} AS rec1_name,
  {service_label('e.cross_recommend_2', "'—'")} AS rec2_name,
  u.segment_name, u.last_active_at, u.process_name
FROM uc u JOIN enr e ON e.user_id = u.user_id LEFT JOIN hints h ON h.user_id = u.user_id""",
    "serve_time_fill": """
SELECT s.user_id, s.cluster_id, s.active_service,
  g.process_type AS cross_recommend_1,
  CASE WHEN g.process_type IS NOT NULL THEN 65.0 END::DOUBLE AS rec1_score,
  CASE WHEN g.process_type IS NOT NULL THEN 'global' END AS rec1_source,
  s.cross_recommend_2, s.rec2_score, s.rec2_source, s.rec1_name
FROM stored_empty s LEFT JOIN (
  SELECT p.user_id, p.process_type,
    row_number() OVER (PARTITION BY p.user_id ORDER BY g.global_rank NULLS LAST, p.position) AS rn
  FROM gapped p LEFT JOIN allrank g ON g.process_type = p.process_type WHERE p.is_gap) g
ON g.user_id = s.user_id AND g.rn = 1""",
    "build_user_clusters": f"SELECT {UC_COLUMNS} FROM uc",
    "build_user_clusters_percentile": f"SELECT {UC_COLUMNS} FROM uc_pct",
    "build_user_clusters_no_model": f"SELECT {UC_COLUMNS} FROM uc_plain",
    "user_summary": """
SELECT a.user_id, CAST(sum(a.interaction_count) AS BIGINT) AS total_actions,
  CAST(count(*) AS INTEGER) AS services_used, CAST(5 - count(*) AS INTEGER) AS gap_count,
  max(a.interaction_count) AS top_service_count, least(max(d.n), 20) AS recent_events
FROM aff a JOIN (SELECT user_id, count(*) AS n FROM done GROUP BY 1) d ON d.user_id = a.user_id
GROUP BY 1""",
    "service_share": """
SELECT a.user_id, a.process_type, a.interaction_count,
  CAST(round_even(100.0 * a.interaction_count / sum(a.interaction_count) OVER (PARTITION BY a.user_id), 0) AS BIGINT) AS share_pct,
  a.process_type = t.active_service AS is_primary
FROM aff a JOIN act t ON t.user_id = a.user_id""",
    "gap_status": """
SELECT g.user_id, g.position, g.process_type,
  CASE WHEN g.process_type = u.cross_recommend_1 THEN 'Rec #1'
       WHEN g.process_type = u.cross_recommend_2 THEN 'Rec #2' ELSE 'Open gap' END AS gap_status
FROM gapped g JOIN uc u ON u.user_id = g.user_id WHERE g.is_gap""",
    "rec_cards": """
SELECT k.user_id, k.rank, k.service, k.label,
  CAST(trunc(greatest(0, least(100, k.score))) AS INTEGER) AS fit,
  coalesce(CAST(trunc(greatest(0, least(100, k.score))) AS INTEGER) || '% fit', 'Ranked by platform trends') AS fit_text,
  coalesce(w.wording, 'Recommended for you') AS source_text
FROM cards k LEFT JOIN wordings w ON w.source = coalesce(nullif(k.source, ''), 'als')""",
    "user_profile": "SELECT * FROM profiled",
    "outreach_audience": rf"""
SELECT user_id,
  CASE WHEN length(slug) < 3 OR slug = 'nan' THEN 'user_' || substr(user_id, 1, 8) ELSE slug END
    || '@example.com' AS recipient,
  '⚡ Discover ' || rec1_name || ' on Gapwise' AS subject, {OUTREACH_BODY} AS body
FROM (SELECT *, lower(regexp_replace(display_name, '[^\p{{L}}\p{{N}}]', '', 'g')) AS slug FROM profiled)
WHERE cross_recommend_1 IS NOT NULL""",
    "clean_title_short": f"SELECT event_id, {title_short('process_name')} AS title FROM track",
    "clean_title": f"SELECT event_id, {title('process_name')} AS title FROM track",
    "display_name": f"""
SELECT event_id, coalesce({title('process_name')}, {generic_name('user_id')}) AS name FROM track""",
    "table_profile": table_profile_sql(),
    "null_audit": """
SELECT count(*) AS users, count(*) FILTER (WHERE cluster_id IS NULL) AS null_cluster,
  count(*) FILTER (WHERE active_service IS NULL) AS null_active_service,
  count(*) FILTER (WHERE cross_recommend_1 IS NULL) AS null_rec1,
  count(*) FILTER (WHERE rec1_score IS NULL) AS null_rec1_score,
  count(*) FILTER (WHERE cross_recommend_2 IS NULL) AS null_rec2
FROM uc""",
    "preview": f"SELECT {UC_COLUMNS} FROM uc ORDER BY user_id LIMIT 5",
}


def oracle_sql() -> dict[str, str]:
    return {name: statement(select) for name, select in FINAL.items()}
