"""SQL of the core's queries, written apart from the DataFrame form."""

from __future__ import annotations

from stepweave import dims
from stepweave.derive import NOW, tables_sql

_S = (
    tables_sql()
    + r""",
b AS (SELECT *, target || '|' || old_s || '|' || new_s AS params_key, '{"file_path": "' || target || '", "k": ' || k || '}' AS params_text,
  tool IN ('read_file', 'grep') AS is_read, tool = 'edit_file' AS is_write, tool = 'bash' AS is_execute FROM steps)
"""
)
_R = (
    _S
    + r""",
c AS (SELECT *,
    max(CASE WHEN is_read THEN ord END) OVER pw AS lr, max(CASE WHEN is_write THEN ord END) OVER pw AS lw,
    row_number() OVER (PARTITION BY traj_id, tool, params_key ORDER BY ord) > 1 AS dup,
    max(CASE WHEN is_write THEN 1 END) OVER (PARTITION BY traj_id, target, new_s, old_s ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ignored
  FROM b WINDOW pw AS (PARTITION BY traj_id, target ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sc AS (SELECT c.*,
    CASE WHEN is_read AND NOT coalesce(lw > lr, lw IS NOT NULL) AND (lr IS NOT NULL OR dup) THEN 0.0 WHEN dup AND NOT is_read THEN 0.3 ELSE 1.0 END AS r1,
    CASE WHEN is_write AND EXISTS (SELECT 1 FROM b p WHERE p.traj_id = c.traj_id AND p.target = c.target AND p.is_write AND p.ord < c.ord AND p.old_s = c.new_s AND p.new_s = c.old_s) THEN 0.0 ELSE 1.0 END AS r2,
    CASE WHEN (is_write OR is_execute) AND ord > 0
      AND NOT EXISTS (SELECT 1 FROM b p WHERE p.traj_id = c.traj_id AND p.ord < c.ord AND contains(lower(c.params_text), lower(split_part(p.output, ' ', 2)))) THEN 0.7 ELSE 1.0 END AS r3
  FROM c),
st AS (SELECT *, (0.15 * least(r1, r2) + 0.15 * r3 + 0.7 * 0.5)::DOUBLE AS step_total FROM sc),
w AS (SELECT t.*, t.success::DOUBLE AS outcome, p.process, 1.0 AS efficiency, round(0.4::DOUBLE * t.success + 0.5::DOUBLE * p.process + 0.1::DOUBLE + 1e-9, 6) AS reward
  FROM trajs t JOIN (SELECT traj_id, avg(step_total) AS process FROM st GROUP BY traj_id) p USING (traj_id))
"""
)
_TEXT = _R + r""", x AS (SELECT traj_id, string_agg('Step ' || (ord + 1) || ':' || chr(10) || 'Action: ' || tool || '(' || target || ')' || chr(10) || 'Observation: ' || output, chr(10) || chr(10) ORDER BY ord) AS text FROM b GROUP BY traj_id)
"""
_ADJ = _R + r""", nx AS (SELECT *, lead(traj_id) OVER o AS n_id, lead(reward) OVER o AS n_reward FROM w WINDOW o AS (PARTITION BY task_id ORDER BY reward DESC, traj_id))
"""
_OUT = _R + r""", rk AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, traj_id) AS rn, count(*) OVER (PARTITION BY task_id) AS n FROM w),
oi AS (SELECT a.task_id, a.traj_id AS chosen, b2.traj_id AS rejected, a.reward - b2.reward AS m, a.reward AS ar, b2.reward AS br, a.n_steps AS an, b2.n_steps AS bn
  FROM rk a JOIN rk b2 ON a.task_id = b2.task_id AND b2.rn = a.n + 1 - a.rn AND a.rn < b2.rn WHERE round(a.reward - b2.reward, 9) >= 0.05)
"""
_CAS = r"""WITH one AS (SELECT content_hash, min(task_id) AS task_id, min(employee) AS employee, min(domain) AS domain, max(CASE WHEN NOT isnan(reward) THEN reward END) AS reward,
  max(gdi_score) AS gdi_score, max(export_count) AS export_count, min(created_at) AS created_at, max(total_steps) AS total_steps FROM trajectories WHERE content_hash IS NOT NULL GROUP BY content_hash)
"""
_EV = r"""WITH e0 AS (SELECT log_id, id, source AS src, action, observation, args, content, thought, "timestamp", extras, min(received_at) AS received_at FROM messages WHERE log_id IS NOT NULL GROUP BY ALL),
e AS (SELECT *, lower(trim(src)) AS source, row_number() OVER (PARTITION BY log_id ORDER BY id NULLS FIRST, received_at, coalesce(content, ''), coalesce(args, '')) AS rn FROM e0)
"""
_PAIRED = _EV + """, p AS (SELECT *, lag(action) OVER w AS b_action, lag(source) OVER w AS b_source, lag(args) OVER w AS b_args, lag(thought) OVER w AS b_thought, lag("timestamp") OVER w AS b_ts, lag(extras.token_count) OVER w AS b_tokens
  FROM e WHERE action IS NOT NULL OR observation IS NOT NULL OR source = 'user' WINDOW w AS (PARTITION BY log_id ORDER BY rn)),
steps AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY rn) - 1 AS step_id,
  CASE b_action WHEN 'run' THEN 'bash' WHEN 'run_ipython' THEN 'ipython' WHEN 'read' THEN 'read_file' WHEN 'write' THEN 'write_file' WHEN 'browse' THEN 'browse_url' WHEN 'edit' THEN 'edit_file' ELSE b_action END AS tool,
  coalesce(b_args, '{}') AS params, coalesce(b_thought, '') AS thought, coalesce(content, '') AS output, coalesce(extras.exit_code, 0) AS exit_code, extras.error AS error, b_ts AS "timestamp", b_tokens AS token_count
  FROM p WHERE observation IS NOT NULL AND action IS NULL AND b_action IS NOT NULL AND b_action NOT IN ('message', 'finish') AND b_source IS DISTINCT FROM 'user')
"""
_OUTCOME = _PAIRED + """, f AS (SELECT log_id, min(rn) AS fid, arg_min(struct_pack(success := CASE WHEN json_extract(args, '$.outputs.test_result') IS NOT NULL THEN coalesce(json_extract_string(args, '$.outputs.test_result.success'), 'false') ELSE json_extract_string(args, '$.outputs.success') END,
    passed := coalesce(json_extract_string(args, '$.outputs.test_result.tests_passed')::INT, 0), failed := coalesce(json_extract_string(args, '$.outputs.test_result.tests_failed')::INT, 0)), rn) AS said FROM e WHERE action = 'finish' GROUP BY log_id),
g AS (SELECT log_id, count(*) AS events, bool_or(fid IS NOT NULL) AS finished, bool_or(coalesce(observation = 'run' AND extras.exit_code = 0 AND regexp_matches(content, 'passed|PASSED') AND (fid IS NULL OR rn < fid), false)) AS passed, any_value(said) AS said FROM e LEFT JOIN f USING (log_id) GROUP BY log_id),
t AS (SELECT log_id, count(*) AS total_steps, coalesce(sum(token_count), 0) AS total_tokens FROM steps GROUP BY log_id),
outcomes AS (SELECT log_id, events, finished, coalesce(said.success = 'true', passed) AS success, coalesce(said.passed, 0) AS tests_passed, coalesce(said.failed, 0) AS tests_failed, coalesce(total_steps, 0) AS total_steps, coalesce(total_tokens, 0) AS total_tokens FROM g LEFT JOIN t USING (log_id))
"""
_GDI = _R + rf""", g AS (SELECT traj_id, least(1, greatest(0, reward)) AS i, CASE WHEN export_count <= 0 THEN 0 ELSE least(1, ln(1 + export_count) / ln(101)) END AS u,
  1 / (1 + greatest(0, (epoch(TIMESTAMP '{NOW}') - created_at) / 86400) * 0.05) AS f FROM w)
"""
_TASKS = r"""WITH tasks AS (SELECT concat('task_', p_partkey) AS task_id, CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'Go' ELSE 'TypeScript' END AS language,
  CASE WHEN p_size < 10 THEN 'easy' WHEN p_size < 30 THEN 'Medium' ELSE 'hard' END AS difficulty, CASE p_size % 2 WHEN 0 THEN 'bug_fix' ELSE 'feature' END AS type, p_size FROM part)
"""
_CAL = _R + r""", xy AS (SELECT round(reward, 2) AS x, round(least(1.0, mean_value / 100), 2) AS y FROM w)
"""
_ORD = r"""WITH o AS (SELECT l_orderkey::VARCHAR AS traj_id, o_custkey::VARCHAR AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord,
  CASE l_returnflag WHEN 'R' THEN 'read_file' WHEN 'A' THEN 'edit_file' ELSE 'bash' END AS tool, concat('part_', l_partkey % 7) AS target, floor(l_quantity)::INT AS length
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def _rows(rows: list[tuple], names: str) -> str:
    value = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({names})"


def _summary(by: str) -> str:
    return (
        _R
        + f""", m AS (SELECT {by}, count(reward) AS n, avg(reward) AS m, coalesce(stddev_samp(reward), 0) AS s, min(reward) AS lo, max(reward) AS hi, avg(success) AS p,
  count(*) FILTER (reward < 0.25) AS bin0, count(*) FILTER (reward >= 0.25 AND reward < 0.5) AS bin1, count(*) FILTER (reward >= 0.5 AND reward < 0.75) AS bin2, count(*) FILTER (reward >= 0.75) AS bin3 FROM w GROUP BY {by}),
h AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE (CASE WHEN n >= 30 THEN 1.96 WHEN n >= 15 THEN 2.13 WHEN n >= 10 THEN 2.26 WHEN n >= 5 THEN 2.78 ELSE 4.30 END) * s / sqrt(n) END AS half, 1.96::DOUBLE AS z FROM m)
"""
    )


def _chunks(ctes: str, source: str, length: str, most: int) -> str:
    budget = most - 50 if most > 50 else most // 2
    return (
        ctes.replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", l AS (SELECT traj_id, ord, ({length})::BIGINT AS n, sum({length}) OVER (PARTITION BY traj_id) AS total FROM {source}),
f AS (SELECT traj_id, ord, n AS used, 0 AS chunk, total FROM l WHERE ord = 0
  UNION ALL SELECT l.traj_id, l.ord, CASE WHEN f.used + l.n > {budget} THEN l.n ELSE f.used + l.n END, CASE WHEN f.used + l.n > {budget} THEN f.chunk + 1 ELSE f.chunk END, l.total FROM f JOIN l ON l.traj_id = f.traj_id AND l.ord = f.ord + 1),
k AS (SELECT traj_id, ord, CASE WHEN total <= {most} THEN 0 ELSE chunk END AS chunk FROM f)
SELECT traj_id, chunk, min(ord) AS first_ord, max(ord) AS last_ord, CASE WHEN chunk = 0 THEN 0 ELSE greatest(min(ord) - 1, 0) END AS context_from FROM k GROUP BY traj_id, chunk"""
    )


_P = "CASE WHEN abs({t}) > 3.5 THEN 'p<0.001' WHEN abs({t}) > 2.5 THEN 'p<0.01' WHEN abs({t}) > 2.0 THEN 'p<0.05' WHEN abs({t}) > 1.5 THEN 'p<0.15' ELSE 'p>0.15' END"
_ARG = "coalesce(json_extract_string(args, '$.content'), content)"

ORACLES = {
    "s3_load_store": "SELECT content_hash, gdi_score, created_at FROM trajectories WHERE gdi_score >= 0.5 ORDER BY gdi_score DESC, content_hash, created_at LIMIT 10000",
    "s7_read_from_store": _CAS + "SELECT content_hash, reward FROM one WHERE reward >= 0.5 AND domain = 'coding' ORDER BY reward DESC, content_hash LIMIT 500",
    "s13_event_pairs": _PAIRED + "SELECT * FROM steps",
    "s15_outcome": _OUTCOME + "SELECT * FROM outcomes",
    "s16_metadata": _EV
    + f"""SELECT log_id, arg_min({_ARG}, rn) FILTER (source = 'user' AND action = 'message' AND {_ARG} IS NOT NULL) AS task, arg_max(extras.model, rn) FILTER (extras.model <> '') AS model, arg_max(extras.agent_class, rn) FILTER (extras.agent_class <> '') AS agent_class,
  arg_max(extras.instance_id, rn) FILTER (extras.instance_id <> '') AS instance_id, arg_max(extras.max_iterations, rn) FILTER (extras.max_iterations IS NOT NULL) AS max_iterations FROM e GROUP BY log_id""",
    "s30_profiles": f"SELECT * FROM {_rows(dims.tool_rows(), 'domain, tool, category, stateful_key')}",
    "f1_filter_tasks": _TASKS + "SELECT task_id FROM tasks WHERE lower(language) = 'python' AND lower(difficulty) = 'medium' AND lower(type) = 'bug_fix'",
    "f3_listing": _CAS + "SELECT content_hash, reward FROM one ORDER BY reward DESC NULLS LAST, content_hash LIMIT 100 OFFSET 50",
    "f4_counts": "SELECT lower(trim(task_id)) AS task_id, count(*) AS n FROM trajectories GROUP BY 1",
    "f5_since": _CAS + "SELECT content_hash, created_at FROM one WHERE created_at > 1770000000 ORDER BY created_at, content_hash LIMIT 100",
    "f6_normalized_steps": """WITH one AS (SELECT traj_id, any_value(steps) AS steps FROM browser_trajectory WHERE traj_id IS NOT NULL GROUP BY traj_id), u AS (SELECT traj_id, unnest(range(len(steps))) AS ord, unnest(steps) AS s FROM one)
SELECT traj_id, ord, coalesce(s.tool_call.name, '') AS tool, coalesce(s.tool_call.parameters, '') AS params, coalesce(s.tool_result.output, '') AS output, coalesce(s.tool_result.exit_code, 0) AS exit_code, coalesce(s.thought, '') AS thought FROM u""",
    "f7_sft_records": _TEXT + """SELECT traj_id, 'Solve task: ' || task_id AS instruction, '{"repo": "", "base_commit": "", "test_command": ""}' AS input, text AS response, reward FROM w JOIN x USING (traj_id) WHERE success = 1""",
    "f8_dpo_records": _TEXT
    + """, nx AS (SELECT *, lead(traj_id) OVER o AS n_id, lead(reward) OVER o AS n_reward FROM w WINDOW o AS (PARTITION BY task_id ORDER BY reward DESC, traj_id))
SELECT 'Solve the following task:' || chr(10) || chr(10) || 'Task ID: ' || task_id AS prompt, a.text AS chosen, c2.text AS rejected, round(reward - n_reward + 1e-9, 6) AS margin FROM nx JOIN x a ON a.traj_id = nx.traj_id JOIN x c2 ON c2.traj_id = nx.n_id WHERE reward <> n_reward""",
    "f9_difficulty": _TASKS + "SELECT task_id, CASE WHEN p_size + 1 < 10 THEN 'easy' WHEN p_size + 1 < 50 THEN 'medium' ELSE 'hard' END AS difficulty FROM tasks",
    "f13_tool_classes": _S + "SELECT tool, CASE tool WHEN 'read_file' THEN 'read' WHEN 'grep' THEN 'search' WHEN 'edit_file' THEN 'write' WHEN 'bash' THEN 'execute' ELSE 'submit' END AS category, is_read, is_write, is_execute, count(*) AS n FROM b GROUP BY ALL",
    "f14_target_param": _S + "SELECT traj_id, ord, target AS found FROM b",
    "f17_rubrics": f"SELECT rubric_set, evaluator, count(*) AS n, round(sum(weight::DOUBLE), 4) AS weight FROM {_rows(dims.rubric_rows(), 'rubric_set, rubric_id, weight, evaluator')} GROUP BY ALL",
    "f18_high_quality": _R + "SELECT traj_id, task_id, agent_model, employee, n_steps, success, reward FROM w WHERE reward >= 0.7",
    "r1_redundancy": _R + "SELECT traj_id, ord, r1::DOUBLE AS r1 FROM sc",
    "r2_regression": _R + "SELECT traj_id, ord, r2::DOUBLE AS r2 FROM sc",
    "r3_info_utilization": _R + "SELECT traj_id, ord, r3::DOUBLE AS r3 FROM sc",
    "r4_info_tokens": _S + "SELECT traj_id, ord, split_part(output, ' ', 2) AS tokens FROM b",
    "r5_efficiency": _S + "SELECT traj_id, round(least(1.0, 8.0 / n_steps), 6)::DOUBLE AS efficiency FROM trajs",
    "r6_outcome": "SELECT o_orderkey, round(coalesce(CASE WHEN o_orderstatus = 'P' THEN greatest(0.0, least(1.0, o_totalprice / 200000)) END, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 7) / (o_custkey % 5) END, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) + 1e-9, 6)::DOUBLE AS score FROM orders",
    "r7_rewards": _R + "SELECT traj_id, task_id, outcome, round(process + 1e-9, 6) AS process, efficiency::DOUBLE AS efficiency, reward FROM w",
    "r11_prefix_scores": _R + "SELECT traj_id, ord, round(step_total, 6) AS step_total FROM st",
    "j2_sampled_steps": _S + "SELECT b.traj_id, ord FROM b JOIN trajs USING (traj_id) WHERE n_steps <= 30 OR ord < 5 OR ord >= n_steps - 5 OR ((ord - 5) % greatest(1, (n_steps - 10) // 21) = 0 AND (ord - 5) // greatest(1, (n_steps - 10) // 21) < 20)",
    "j6_median_filled": _S
    + """, q AS (SELECT traj_id, ord, CASE WHEN ord % 3 <> 2 THEN round(value, 2) END AS score FROM b), s2 AS (SELECT traj_id, list_sort(list(score) FILTER (score IS NOT NULL)) AS l FROM q GROUP BY traj_id)
SELECT q.traj_id, ord, score, coalesce(score, l[len(l) // 2 + 1], 0.5) AS filled FROM q JOIN s2 USING (traj_id)""",
    "pg1_adjacent": _ADJ + "SELECT task_id, traj_id AS chosen, n_id AS rejected, round(reward - n_reward + 1e-9, 6) AS margin FROM nx WHERE reward <> n_reward",
    "pg2_outside_in": _OUT
    + """SELECT task_id, chosen, rejected, round(m, 6) AS margin, printf('chosen scored %.3f vs rejected %.3f (margin=%.3f)', round(ar + 1e-9, 3), round(br + 1e-9, 3), round(m + 1e-9, 3)) || CASE WHEN an < bn THEN printf('; chosen used fewer steps (%d vs %d)', an, bn)
  WHEN an > bn THEN printf('; chosen used more steps (%d vs %d) but achieved higher quality', an, bn) ELSE '' END AS rationale FROM oi""",
    "pg3_adjacent_ties": _ADJ + "SELECT task_id, traj_id AS chosen, n_id AS rejected, round(reward - n_reward + 1e-9, 4) AS margin FROM nx WHERE n_id IS NOT NULL AND task_id <> ''",
    "pg4_by_employee": _R + ", ny AS (SELECT *, lead(traj_id) OVER o AS n_id, lead(reward) OVER o AS n_reward FROM w WINDOW o AS (PARTITION BY employee ORDER BY reward DESC, traj_id)) SELECT employee, traj_id AS chosen, n_id AS rejected, round(reward - n_reward + 1e-9, 6) AS margin FROM ny WHERE reward <> n_reward",
    "pg5_judge_batch": _R
    + """, q AS (SELECT * FROM w WHERE reward BETWEEN 0.3 AND 0.7 AND task_id <> '' ORDER BY task_id, reward DESC, traj_id LIMIT 1000), q2 AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS c2 FROM q),
q3 AS (SELECT *, lead(traj_id) OVER o AS n_id, lead(reward) OVER o AS n_reward FROM q2 WHERE c2 >= 2 WINDOW o AS (PARTITION BY task_id ORDER BY reward DESC, traj_id))
SELECT task_id, traj_id AS chosen, n_id AS rejected, round(reward - n_reward + 1e-9, 4) AS margin FROM q3 WHERE n_id IS NOT NULL ORDER BY task_id, chosen LIMIT 10""",
    "pg6_summary": _OUT + "SELECT count(*) AS n_pairs, count(DISTINCT task_id) AS n_tasks, round(coalesce(avg(round(m, 6)), 0), 4) AS avg_margin, round(coalesce(min(round(m, 6)), 0), 4) AS min_margin, round(coalesce(max(round(m, 6)), 0), 4) AS max_margin FROM oi",
    "pg7_by_task": _R + ", q AS (SELECT * FROM w WHERE reward BETWEEN 0.4 AND 0.9 AND task_id <> '' ORDER BY task_id, reward DESC, traj_id LIMIT 300) SELECT task_id, traj_id, reward FROM q QUALIFY count(*) OVER (PARTITION BY task_id) >= 2",
    "pg14_task_agents": _S + "SELECT DISTINCT task_id, agent FROM trajs, (VALUES ('openhands'), ('sweagent'), ('crew')) a(agent)",
    "pg16_tool_difference": _S
    + """SELECT coalesce((SELECT string_agg(tool, ',' ORDER BY tool) FROM (SELECT DISTINCT tool FROM b WHERE traj_id = 't1-w0' EXCEPT SELECT tool FROM b WHERE traj_id = 't2-w0')), '') AS only_a,
  coalesce((SELECT string_agg(tool, ',' ORDER BY tool) FROM (SELECT DISTINCT tool FROM b WHERE traj_id = 't2-w0' EXCEPT SELECT tool FROM b WHERE traj_id = 't1-w0')), '') AS only_b,
  coalesce((SELECT string_agg(tool, ',' ORDER BY tool) FROM (SELECT tool FROM b WHERE traj_id = 't2-w0' INTERSECT SELECT tool FROM b WHERE traj_id = 't1-w0')), '') AS shared,
  (SELECT count(*) FROM b WHERE traj_id = 't1-w0') AS n_a, (SELECT count(*) FROM b WHERE traj_id = 't2-w0') AS n_b""",
    "pg17_replay": _S
    + """, q AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'other' ELSE output END AS expected FROM b)
SELECT traj_id, count(expected) AS compared, coalesce(min(ord) FILTER (expected <> output), -1) AS first_divergence, min(ord) FILTER (expected <> output) IS NULL AS success FROM q GROUP BY traj_id""",
    "pg18_pairwise": _R
    + f""", m AS (SELECT agent_model, count(*) AS n, avg(reward) AS m, coalesce(var_samp(reward), 0) AS v FROM w GROUP BY 1),
q AS (SELECT a.agent_model AS a, c2.agent_model AS b, a.n < 2 OR c2.n < 2 AS few, sqrt(a.v / a.n + c2.v / c2.n) AS se, a.m - c2.m AS d, sqrt((a.v + c2.v) / 2) AS pooled FROM m a JOIN m c2 ON a.agent_model < c2.agent_model),
q2 AS (SELECT a, b, round(CASE WHEN few OR se < 1e-10 THEN 0 ELSE d / se END, 4) AS t, CASE WHEN few OR se < 1e-10 THEN 0 ELSE round(d / pooled, 4) END AS effect, few, se FROM q),
q3 AS (SELECT a, b, t, effect, CASE WHEN few THEN 'insufficient_data' WHEN se < 1e-10 THEN 'identical' ELSE {_P.format(t="t")} END AS p, abs(t) > 2.0 AS significant, count(*) OVER () AS k FROM q2)
SELECT a, b, t, effect, p, significant, CASE p WHEN 'p<0.001' THEN 0.001 WHEN 'p<0.01' THEN 0.01 WHEN 'p<0.05' THEN 0.05 WHEN 'p<0.15' THEN 0.15 ELSE 1 END < 0.05 / k AS significant_corrected FROM q3""",
    "d1_deduplicated": _R
    + """, h AS (SELECT traj_id, left(sha256('[' || string_agg('{"output": "' || output || '", "params": {"path": "' || target || '"}, "tool": "' || tool || '"}', ', ' ORDER BY ord) || ']'), 16) AS content_hash FROM b GROUP BY traj_id)
SELECT content_hash, count(*) AS rows, arg_min(task_id, (created_at, reward)) AS task_id, max(reward) AS reward FROM w JOIN h USING (traj_id) GROUP BY content_hash""",
    "d3_desirability": _GDI + "SELECT traj_id, round(i + 1e-9, 4)::DOUBLE AS intrinsic, round(u + 1e-9, 4)::DOUBLE AS utility, 0.5::DOUBLE AS feedback, round(f + 1e-9, 4)::DOUBLE AS freshness, round(0.35 * i + 0.30 * u + 0.20 * 0.5 + 0.15 * f + 1e-9, 4)::DOUBLE AS total FROM g",
    "d4_ranked": _GDI + "SELECT traj_id, round(0.35 * i + 0.30 * u + 0.20 * 0.5 + 0.15 * f + 1e-9, 4)::DOUBLE AS total FROM g",
    "d6_feedback": _CAS
    + """SELECT content_hash, CASE WHEN reward > 0.6 THEN round(0.35 * least(1, greatest(0, reward)) + 0.30 * (CASE WHEN export_count <= 0 THEN 0 ELSE least(1, ln(1 + export_count) / ln(101)) END) + 0.20 * 0.9 + 0.15 / (1 + greatest(0, (1780000000 - created_at) / 86400) * 0.05) + 1e-9, 4)::DOUBLE ELSE gdi_score END AS gdi_score FROM one WHERE reward IS NOT NULL""",
    "d7_exported": _CAS + "SELECT content_hash, export_count + CASE WHEN reward > 0.8 THEN 1 ELSE 0 END AS export_count FROM one",
    "d8_migrated": _CAS + "SELECT '' AS channel, count(*) AS n FROM one",
    "a1_stats": _CAS + "SELECT count(*) AS total, count(DISTINCT task_id) AS tasks, count(DISTINCT employee) AS employees, round(coalesce(avg(reward), 0), 4) AS avg_reward, round(coalesce(avg(gdi_score), 0), 4) AS avg_gdi, coalesce(sum(export_count), 0) AS exports FROM one",
    "a2_iterations": _S + ", q AS (SELECT traj_id, week, sum(round(value, 2)) AS ret, count(*) AS n FROM b GROUP BY ALL) SELECT week, count(*) AS trajectories, round(avg(ret), 4) AS avg_return, round(min(ret), 4) AS min_return, round(max(ret), 4) AS max_return, round(avg(n), 4) AS avg_steps FROM q GROUP BY week",
    "a3_summaries": _summary("agent_model")
    + """SELECT agent_model, n, round(m, 4) AS mean, round(s, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, bin0, bin1, bin2, bin3, round(m - half, 4) AS ci_low, round(m + half, 4) AS ci_high, round(p, 4) AS success_rate,
  round((p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n), 4) AS wilson_low, round((p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n), 4) AS wilson_high FROM h""",
    "a6_leaderboard": _R + ", q AS (SELECT agent_model, count(*) AS n, round(avg(reward), 6) AS avg_reward, round(avg(success), 6) AS success_share FROM w GROUP BY 1) SELECT *, row_number() OVER (ORDER BY avg_reward DESC, agent_model) AS place FROM q",
    "a9_datacard": _R + "SELECT employee, count(*) AS n, round(avg(success), 4) AS success_rate, round(avg(reward), 4) AS avg_reward, round(avg(n_steps), 4) AS avg_steps, count(DISTINCT agent_model) AS models FROM w GROUP BY employee",
    "a10_calibration": _CAL
    + """, r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM xy)
SELECT count(*) AS n, round(corr(x, y), 4) AS pearson, round(corr(rx, ry), 4) AS spearman, round(avg(abs(x - y)), 4) AS mae, round(max(abs(x - y)), 4) AS max_error, round(min(abs(x - y)), 4) AS min_error FROM r""",
    "a13_agreement": _CAL + ", i AS (SELECT *, row_number() OVER (ORDER BY x, y) AS k FROM xy) SELECT count(*) AS pairs, round(avg(CASE WHEN sign(a.x - c2.x) = sign(a.y - c2.y) THEN 1 ELSE 0 END), 4) AS agreement FROM i a JOIN i c2 ON a.k < c2.k",
    "a15_advantages": _R + ", q AS (SELECT traj_id, reward, count(*) OVER p AS n, avg(reward) OVER p AS m, stddev_samp(reward) OVER p AS s FROM w WINDOW p AS (PARTITION BY task_id)) SELECT traj_id, round((reward - m) / (s + 1e-8), 4) AS advantage FROM q WHERE n >= 2",
    "a16_step_weights": _R + "SELECT traj_id, ord, round(step_total / (avg(step_total) OVER (PARTITION BY traj_id) + 1e-8), 4) AS step_weight FROM st",
    "a17_step_means": _R + ", q AS (SELECT traj_id, round(step_total / (avg(step_total) OVER (PARTITION BY traj_id) + 1e-8), 4) AS sw FROM st) SELECT traj_id, round(avg(sw), 4) AS mean_weight FROM q GROUP BY 1",
    "a18_difficulties": _R + "SELECT traj_id, round(n_steps - reward, 6) AS difficulty FROM w",
    "t1_intervals": _summary("employee") + "SELECT employee, round(m, 4) AS mean, round(m - half, 4) AS ci_low, round(m + half, 4) AS ci_high FROM h",
    "t4_paired": _CAL + f", q AS (SELECT count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS s FROM xy) SELECT n, round(m / (s / sqrt(n)), 4) AS t, round(m / s, 4) AS effect, n - 1 AS df, {_P.format(t='(m / (s / sqrt(n)))')} AS p FROM q",
    "t5_mann_whitney": f"""WITH r AS (SELECT o_orderstatus = 'F' AS is_a, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS rk FROM orders),
q AS (SELECT sum(rk) FILTER (is_a) AS ra, (count(*) FILTER (is_a))::DOUBLE AS n1, (count(*) FILTER (NOT is_a))::DOUBLE AS n2 FROM r), q2 AS (SELECT n1, n2, least(ra - n1 * (n1 + 1) / 2, n1 * n2 - (ra - n1 * (n1 + 1) / 2)) AS u FROM q),
q3 AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM q2) SELECT round(u, 4) AS u, round(z, 4) AS z, round(1 - 2 * u / (n1 * n2), 4) AS effect, {_P.format(t="z")} AS p FROM q3""",
    "o1_export_order": _R + "SELECT traj_id, reward FROM w WHERE success = 1",
    "o5_split": _S + ", q AS (SELECT traj_id, row_number() OVER (ORDER BY md5('42-' || traj_id), traj_id) AS rn, count(*) OVER () AS n FROM trajs) SELECT traj_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM q",
    "o6_curriculum": _R + ", q AS (SELECT traj_id, row_number() OVER (ORDER BY n_steps - reward, traj_id) AS rn, count(*) OVER () AS n FROM w) SELECT traj_id FROM q WHERE rn <= greatest(1, ceil(n * (0.3::DOUBLE + 0.7::DOUBLE / 3)))",
    "o9_union": _R + "SELECT traj_id, reward FROM w",
    "o11_assigned": _S + "SELECT traj_id, user_id % 4 AS worker FROM trajs",
    "x5_truncated": _S + "SELECT traj_id, ord, tool = 'submit' AS terminated, ord + 1 >= 6 AND tool <> 'submit' AS truncated FROM b",
    "x6_timed_out": _S + "SELECT traj_id, ord, epoch(ts) - epoch(first_value(ts) OVER (PARTITION BY traj_id ORDER BY ord)) >= 172800 AS timed_out FROM b",
    "x8_recorded": _S + "SELECT traj_id, count(*) AS n_steps, arg_max(tool = 'submit' AND NOT (ord + 1 >= 6 AND tool <> 'submit'), ord) AS success FROM b GROUP BY traj_id",
    "x9_running": _S + "SELECT traj_id, ord, round(sum(round(value, 2)) OVER (PARTITION BY traj_id ORDER BY ord), 4) AS return_so_far, ord + 1 AS length_so_far FROM b",
    "x10_shortened": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '... [truncated]' ELSE text END AS text FROM documents",
    "x12_early_stop": _R
    + """, q AS (SELECT regexp_extract(traj_id, 'w([0-9]+)$', 1)::INT AS iteration, round(avg(reward), 4) AS mean FROM w GROUP BY 1), q2 AS (SELECT *, coalesce(mean > max(mean) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM q)
SELECT iteration, mean, iteration - max(CASE WHEN better THEN iteration END) OVER (ORDER BY iteration) = 2 AS stop FROM q2""",
    "x15_sessions": """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sess FROM g)
SELECT user_id, count(*) AS n_events, round(sum(value), 4) AS total FROM k GROUP BY user_id, sess""",
    "e4_steps_text": _TEXT + "SELECT traj_id, text FROM x",
    "e11_actions": _S + """SELECT traj_id, ord, tool, '{"' || CASE tool WHEN 'read_file' THEN 'file_path' WHEN 'edit_file' THEN 'file_path' WHEN 'bash' THEN 'command' WHEN 'grep' THEN 'pattern' ELSE 'conclusion' END || '":"' || target || '"}' AS params FROM b""",
    "e14_shortened": "SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || chr(10) || '... (truncated, ' || length(text) || ' chars total)' ELSE text END AS text FROM documents",
    "e16_chunks": _chunks(_S, "b", "length(output) + k", 200),
    "e16_order_chunks": _chunks(_ORD, "o", "length", 120),
    "r1_order_redundancy": _ORD
    + """, q AS (SELECT *, tool = 'read_file' AS is_read, max(CASE WHEN tool = 'read_file' THEN ord END) OVER p AS lr, max(CASE WHEN tool = 'edit_file' THEN ord END) OVER p AS lw, row_number() OVER (PARTITION BY traj_id, tool, target ORDER BY ord) > 1 AS dup
  FROM o WINDOW p AS (PARTITION BY traj_id, target ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q2 AS (SELECT task_id, CASE WHEN is_read AND NOT coalesce(lw > lr, lw IS NOT NULL) AND (lr IS NOT NULL OR dup) THEN 0 WHEN dup AND NOT is_read THEN 3 ELSE 10 END AS r1 FROM q)
SELECT task_id, count(*) AS n, count(*) FILTER (r1 = 0) AS needless, count(*) FILTER (r1 = 3) AS repeats FROM q2 GROUP BY task_id""",
}
