"""SQL of the queries that SQL can express."""

_EVENTS = r"""
WITH m AS (SELECT DISTINCT log_id, id, source, action, observation, args, content, thought, "timestamp", extras::VARCHAR AS extras FROM messages WHERE log_id IS NOT NULL),
e AS (
  SELECT log_id, id, lower(regexp_replace(source, '^[\s　 ]+|[\s　 ]+$', '', 'g')) AS speaker,
    nullif(trim(action), '') AS action, nullif(trim(observation), '') AS observation,
    coalesce(CASE WHEN NOT regexp_full_match(json_extract_string(args, '$.content'), '[\s\x{3000}\x{00a0}]*') THEN json_extract_string(args, '$.content') END,
             CASE WHEN NOT regexp_full_match(content, '[\s\x{3000}\x{00a0}]*') THEN content END) AS text
  FROM m),
s AS (
  SELECT *, coalesce(speaker IN ('user', 'agent') AND action = 'message' AND text IS NOT NULL, false) AS says,
    coalesce(speaker = 'user' AND action = 'message', false) AS usr, coalesce(speaker = 'agent', false) AS agt,
    count(*) OVER (PARTITION BY log_id, id) AS sharing,
    lag(speaker) OVER w AS p_speaker, lag(action) OVER w AS p_action
  FROM e WINDOW w AS (PARTITION BY log_id ORDER BY id)),
t AS (SELECT *, sum(usr::INT) OVER (PARTITION BY log_id ORDER BY id) AS turn FROM s),
turns AS (SELECT log_id, turn, bool_or(agt) AS anyone, bool_or(agt AND says) AS reply FROM t GROUP BY log_id, turn),
unanswered AS (
  SELECT log_id, bool_or(turn > 0 AND NOT reply AND (anyone OR turn = top)) AS bad
  FROM (SELECT *, max(turn) OVER (PARTITION BY log_id) AS top FROM turns) GROUP BY log_id),
logs AS (
  SELECT log_id, bool_or(says) AS said,
    bool_or(sharing > 1 OR id IS NULL OR (action IS NULL AND observation IS NULL)
      OR (observation IS NOT NULL AND NOT coalesce(p_speaker = 'agent' AND p_action = observation, false))) AS wrong,
    arg_min(speaker, CASE WHEN says THEN id END) AS first_says
  FROM t GROUP BY log_id),
defects AS (
  SELECT log_id, CASE WHEN NOT said THEN 'empty' WHEN wrong OR first_says = 'agent' THEN 'broken' WHEN bad THEN 'no_reply' END AS defect
  FROM logs JOIN unanswered USING (log_id))
""".replace(r"　", r"\x{3000}").replace(r" ", r"\x{00a0}")

_ONE = """
one AS (
  SELECT content_hash, max(CASE WHEN NOT isnan(reward) THEN reward END) AS reward, max(CASE WHEN NOT isnan(gdi_score) THEN gdi_score END) AS gdi_score,
    min(employee) AS employee, min(agent_model) AS agent_model, min(lower(trim(task_id))) AS task_id
  FROM trajectories WHERE content_hash IS NOT NULL GROUP BY content_hash)
"""

_CAPPED = (
    "WITH "
    + _ONE
    + r""",
both_kinds AS (SELECT content_hash, reward, gdi_score, 'employee' AS kind, employee AS value FROM one UNION ALL SELECT content_hash, reward, gdi_score, 'agent_model', agent_model FROM one),
plain AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(value)), '[\s_\x{2010}-\x{2015}-]+', '-', 'g'),
    '^(@|crew/|gateway/|openhub/|proxy:)', ''), '(@latest|:stable)$', ''), '-20[0-9]{6}$', '') AS name FROM both_kinds),
ranked AS (
  SELECT p.kind, p.content_hash, c.name, c.cap_pct,
    row_number() OVER (PARTITION BY p.kind, c.name ORDER BY reward DESC NULLS LAST, gdi_score DESC NULLS LAST, content_hash) AS r
  FROM plain p LEFT JOIN contributors c ON c.kind = p.kind AND c.name = p.name)
"""
)

ORACLES = {
    "p1_found": _EVENTS + "SELECT log_id, defect FROM defects WHERE defect IS NOT NULL",
    "p1_conversations": _EVENTS
    + """SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY id) - 1 AS pos, id, CASE WHEN observation IS NOT NULL THEN 'tool' ELSE speaker END AS role,
  CASE WHEN observation IS NOT NULL THEN 'observation' WHEN action = 'message' THEN 'message' ELSE 'action' END AS kind, coalesce(observation, action) AS name, text
FROM e WHERE log_id IN (SELECT log_id FROM defects WHERE defect IS NULL)""",
    "p3_found": _CAPPED + "SELECT kind, content_hash FROM ranked WHERE name IS NOT NULL AND r > floor(cap_pct * (SELECT count(*) FROM one) / 100)",
    "p3_capped": _CAPPED + "SELECT kind, content_hash, name, (name IS NULL OR r <= floor(cap_pct * (SELECT count(*) FROM one) / 100)) AS kept FROM ranked",
    "p4_found": "WITH "
    + _ONE
    + """SELECT task_id, content_hash FROM one WHERE reward IS NOT NULL AND task_id <> ''
QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, gdi_score DESC NULLS LAST, content_hash) <= 3""",
}
