"""DuckDB SQL that gives the rows of the reports from the same tables, written apart from the Spark plans."""

from __future__ import annotations

from .reports import ZONES

_LEDGER = """
ev AS (
  SELECT event_id AS e, epoch_us(ts) AS us, ts, user_id AS u, event_type AS et, value AS v, json_extract_string(props, '$.k')::BIGINT AS k, user_id // 10 AS g FROM events
), ev1 AS (
  SELECT *, CASE u % 5 WHEN 0 THEN 'claude' WHEN 1 THEN 'claude-desktop' WHEN 4 THEN 'gemini' ELSE 'codex' END AS agent,
    CASE WHEN k % 3 = 0 AND et = 'error' AND k < 30 THEN '' ELSE 'p' || (k % 3) END AS provider,
    200 + k * 100 AS ms, CASE WHEN k % 11 = 0 THEN 0 ELSE 100 + k * 3 END AS ttft_ms FROM ev
), ev2 AS (
  SELECT *, CASE WHEN agent <> 'codex' OR u % 10 = 2 THEN '' WHEN e % 20 = 0 THEN 'unknown' WHEN e % 4 = 1 THEN 'subagent' ELSE 'main' END AS session_role FROM ev1
), led AS (
  SELECT e AS id, us * 1000 AS t_ns, strftime(ts, '%Y-%m-%d') AS local_day, agent, provider, session_role, u, g, k,
    CASE WHEN k % 4 = 0 THEN '' ELSE upper(agent) END AS agent_name, CASE WHEN k % 5 = 0 THEN '' ELSE upper(provider) END AS provider_name,
    CASE WHEN k % 50 = 0 THEN '' ELSE 'm' || (k % 7) END AS model, CASE u % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS effort,
    CASE WHEN agent = 'codex' AND session_role = '' THEN CASE k % 4 WHEN 0 THEN 'collab_spawn' WHEN 1 THEN 'thread_spawn' WHEN 2 THEN 'review' ELSE 'agent_job' END ELSE '' END AS kind,
    CASE WHEN k = 97 OR (session_role = 'subagent' AND k % 16 = 15) THEN '' ELSE 's' || g END AS session,
    CASE WHEN agent IN ('claude', 'claude-desktop') AND k % 2 = 0 THEN 's' || g ELSE '' END AS native_session,
    CASE WHEN session_role = 'subagent' AND k <> 96 THEN 'a' || u WHEN agent = 'claude' AND k % 5 = 1 THEN 'w' || (k % 4) ELSE '' END AS subagent,
    CASE WHEN session_role = 'subagent' THEN CASE WHEN k % 8 = 0 THEN 'a' || (u - u % 10 + 7) ELSE '' END
         WHEN agent = 'claude' AND k % 5 = 1 THEN CASE WHEN k % 4 = 1 THEN 'w0' WHEN k % 4 = 2 AND k > 50 THEN 'w1' WHEN k % 4 = 2 THEN 'w3' ELSE '' END ELSE '' END AS parent_agent,
    CASE WHEN e % 3 = 0 THEN 'log' ELSE 'gateway' END AS source,
    CASE WHEN et = 'error' THEN CASE WHEN k % 2 = 0 THEN 500 ELSE 429 END ELSE 200 END AS status, et = 'error' AND k % 10 = 0 AS rejected,
    CASE WHEN et = 'purchase' AND k = 13 THEN 'stream closed' ELSE '' END AS error, 1 + k % 3 AS tries,
    CASE WHEN k = 95 THEN 0 ELSE floor(v * 100)::BIGINT END AS input, CASE WHEN k = 95 THEN 0 ELSE floor(v * 40)::BIGINT END AS output,
    CASE WHEN k % 6 = 0 THEN 0 ELSE k * 50 END AS cache_read, (k % 10) * 20 AS cache_write, (k % 5) * 4 AS cache_write_1h,
    CASE WHEN k % 4 = 0 THEN floor(v * 10)::BIGINT ELSE 0 END AS reasoning, ms, ttft_ms,
    CASE WHEN k % 8 = 0 THEN ttft_ms + k * 10 ELSE 0 END AS first_text_ms, CASE WHEN k % 4 = 0 THEN ttft_ms + 10 ELSE 0 END AS first_reasoning_ms,
    CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN ms // 10 ELSE ms - ttft_ms END AS flow_ms, k % 12 = 0 AS reasoning_hidden, k % 9 = 0 AS handed_on,
    CASE WHEN agent <> 'codex' OR (g % 3 = 0 AND k % 10 = 3) THEN NULL ELSE k % 4 = 1 END AS compaction, floor(v * 1000) / 100000.0::DOUBLE AS cost, k % 10 <> 9 AS priced, 'acc' || (u % 4) AS account, 'key' || (u % 6) AS caller,
    CASE WHEN agent IN ('claude', 'claude-desktop') THEN 'claude' ELSE agent END AS fam FROM ev2
)"""

_PROJECT = """CASE WHEN cwd = '' THEN 'projectless' WHEN regexp_matches(cwd, '^/tmp/claude-[^/]') OR regexp_matches(cwd, '^/var/folders/[^/]+/[^/]+/T/magpie-claude-work-[^/]') THEN 'workspace' ELSE 'project' END"""

_META = f""", raw AS (
  SELECT agent, 's' || g AS id, g, min(t_ns) AS start_ns, max(t_ns) AS last_ns, '' AS role, '' AS parent_session, '' AS root_session FROM led WHERE agent <> 'codex' AND g % 7 <> 6 GROUP BY agent, g
  UNION ALL
  SELECT agent, 's' || g, g, min(t_ns), max(t_ns), CASE g % 4 WHEN 0 THEN '' WHEN 1 THEN 'unknown' ELSE 'main' END, '', CASE WHEN g % 4 >= 2 THEN 's' || g ELSE '' END FROM led WHERE agent = 'codex' AND g % 7 <> 6 GROUP BY agent, g
  UNION ALL
  SELECT agent, 'a' || u, g, min(t_ns), max(t_ns), CASE WHEN u % 10 = 8 AND g % 2 = 0 THEN 'unknown' ELSE 'subagent' END,
    CASE WHEN u % 10 = 8 AND g % 2 = 0 THEN '' WHEN u % 10 = 7 THEN 's' || g WHEN u % 10 = 3 THEN 'a' || (u - u % 10 + 7) ELSE '' END,
    CASE WHEN (u % 10 = 8 AND g % 2 = 0) OR g % 5 = 4 THEN '' ELSE 's' || g END FROM led WHERE agent = 'codex' AND u % 10 <> 2 GROUP BY agent, u, g
  UNION ALL
  SELECT 'gemini', 'idle' || g, g, min(t_ns), max(t_ns), '', '', '' FROM led WHERE g % 2 = 0 GROUP BY g
), ses AS (
  SELECT *, CASE g % 6 WHEN 0 THEN '' WHEN 1 THEN '/tmp/claude-501/w' || g WHEN 2 THEN '/work/alpha' WHEN 3 THEN CASE WHEN agent = 'claude-desktop' THEN '/work/desk' ELSE '/work/beta' END
      WHEN 4 THEN '/var/folders/x/y/T/magpie-claude-work-9/c' ELSE '/work/p' || g END AS cwd, 'T' || id AS title, CASE WHEN role = 'subagent' THEN 'N' || id ELSE '' END AS nickname FROM raw
), meta0 AS (
  SELECT CASE WHEN agent IN ('claude', 'claude-desktop') THEN 'claude' ELSE agent END AS agent, id, first(cwd ORDER BY (agent = 'claude') DESC, agent DESC) AS cwd,
    first(title ORDER BY (agent = 'claude') DESC, agent DESC) AS title, first(nickname ORDER BY (agent = 'claude') DESC, agent DESC) AS nickname,
    min(start_ns) AS start_ns, max(last_ns) AS last_ns, max(CASE WHEN agent = 'codex' THEN role ELSE '' END) AS role, max(CASE WHEN agent = 'codex' THEN parent_session ELSE '' END) AS parent_session,
    max(CASE WHEN agent = 'codex' THEN root_session ELSE '' END) AS root_session FROM ses GROUP BY 1, 2
), meta AS (
  SELECT *, {_PROJECT} AS kind, CASE WHEN cwd = '' THEN '' ELSE cwd END AS path, CASE WHEN {_PROJECT} = 'project' THEN split_part(cwd, '/', -1) ELSE '' END AS name FROM meta0
)"""

_FAILED = "(status >= 400 OR error <> '')"
_OWN = """SELECT id, tok AS tokens, ms - start AS win FROM (
    SELECT *, CASE WHEN reasoning > 0 THEN output - reasoning ELSE output END AS tok, CASE WHEN reasoning > 0 THEN first_text_ms ELSE ttft_ms END AS start FROM led
  ) WHERE status < 400 AND error = '' AND ttft_ms > 0 AND start > 0 AND tok > 0 AND ms - start >= 100 AND tok * 1000 <= 10000 * (ms - start)
    AND NOT (flow_ms > 0 AND flow_ms * 4 < ms - start) AND NOT (reasoning > 0 AND tok * (first_text_ms - ttft_ms) > 20 * reasoning * (ms - start))"""
_METRIC = """SELECT id, tok AS tokens, ms - start AS win FROM (
    SELECT *, CASE WHEN reasoning > 0 AND first_text_ms > 0 THEN output - reasoning ELSE output END AS tok,
      CASE WHEN reasoning > 0 AND first_text_ms > 0 THEN first_text_ms WHEN reasoning > 0 THEN first_reasoning_ms ELSE ttft_ms END AS start FROM led
  ) WHERE status < 400 AND error = '' AND ttft_ms > 0 AND NOT (reasoning_hidden AND first_text_ms <= 0)
    AND (reasoning <= 0 OR first_text_ms > 0 OR (first_reasoning_ms >= ttft_ms AND flow_ms > 0 AND reasoning <= output))
    AND start > 0 AND tok > 0 AND ms - start >= 100 AND tok * 1000 <= 10000 * (ms - start) AND NOT (flow_ms > 0 AND flow_ms * 4 < ms - start)
    AND NOT (reasoning > 0 AND first_text_ms > 0 AND tok * (first_text_ms - ttft_ms) > 20 * reasoning * (ms - start))
    AND NOT (source = 'log' AND fam = 'codex' AND (ms - start < 1000 OR tok < 100))"""

_IDENTITY = """CASE WHEN fam <> 'codex' OR session_role = '' THEN CASE WHEN native_session <> '' THEN native_session ELSE session END
      WHEN session_role = 'main' THEN session WHEN session_role = 'subagent' AND subagent <> '' AND session = '' THEN subagent ELSE session END AS resolved_id,
    CASE WHEN fam <> 'codex' OR session_role = '' THEN CASE WHEN native_session <> '' THEN native_session ELSE session END
      WHEN session_role = 'subagent' AND subagent <> '' THEN subagent ELSE session END AS actor_id,
    CASE WHEN fam <> 'codex' OR session_role = '' THEN '' WHEN session_role = 'main' AND session <> '' THEN 'main' WHEN session_role = 'subagent' AND subagent <> '' THEN 'subagent' ELSE 'unknown' END AS role"""


def _rows(where: str = "TRUE", project: str = "TRUE") -> str:
    return f""", own AS ({_OWN}), met AS ({_METRIC}), idd AS (
  SELECT *, rejected OR (provider = '' AND status >= 400) AS refused, CASE WHEN model = '' THEN '未知模型' ELSE model END AS model_name, {_IDENTITY} FROM led
), rows AS (
  SELECT i.* EXCLUDE (agent, cost), i.fam AS agent, i.cost::DECIMAL(38, 10) AS cost, a.id IS NOT NULL AS matched, b.id IS NOT NULL AS actor_matched,
    coalesce(a.kind, b.kind, 'unknown') AS p_kind, coalesce(a.path, b.path, '') AS p_path, coalesce(a.name, b.name, '') AS p_name,
    {_FAILED} AS failed, o.tokens AS o_tok, o.win AS o_win, m.tokens AS m_tok, m.win AS m_win,
    row_number() OVER (ORDER BY t_ns, i.fam, resolved_id, subagent, provider, i.model, effort, i.id) AS pos
  FROM idd i LEFT JOIN meta a ON a.agent = i.fam AND a.id = i.resolved_id LEFT JOIN meta b ON b.agent = i.fam AND b.id = i.actor_id
  LEFT JOIN own o ON o.id = i.id LEFT JOIN met m ON m.id = i.id
  WHERE NOT refused AND resolved_id <> '' AND ({where}) AND ({project})
)"""


_SUMS = """count(*) FILTER (W) AS calls, count(*) FILTER (W AND failed) AS errors, count(*) FILTER (W AND NOT failed AND tries > 1) AS retried,
  coalesce(sum(input) FILTER (W), 0)::BIGINT AS input, coalesce(sum(output) FILTER (W), 0)::BIGINT AS output, coalesce(sum(cache_read) FILTER (W), 0)::BIGINT AS cache_read,
  coalesce(sum(cache_write) FILTER (W), 0)::BIGINT AS cache_write, coalesce(sum(cache_write_1h) FILTER (W), 0)::BIGINT AS cache_write_1h, coalesce(sum(reasoning) FILTER (W), 0)::BIGINT AS reasoning,
  count(*) FILTER (W AND input + output > 0 AND NOT priced) AS unpriced, coalesce(sum(o_win) FILTER (W), 0)::BIGINT AS decode_ms, coalesce(sum(o_tok) FILTER (W), 0)::BIGINT AS decode_out,
  count(o_tok) FILTER (W) AS decode_n, coalesce(sum(cost) FILTER (W), 0)::DECIMAL(38, 10) AS cost_sum"""
_NAMES = ("calls", "errors", "retried", "input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning", "unpriced", "decode_ms", "decode_out", "decode_n", "cost_sum")
_VIEW = """calls, errors, retried, input, output, cache_read, cache_write, cache_write_1h, reasoning, unpriced, decode_n, round(cost_sum::DOUBLE, 6) AS cost,
  input + cache_read + cache_write + output AS total, CASE WHEN input + cache_read + cache_write > 0 THEN round(cache_read / (input + cache_read + cache_write), 9) END AS cache_hit_rate,
  CASE WHEN decode_ms > 0 THEN round(decode_out * 1000.0::DOUBLE / decode_ms, 9) END AS output_speed"""


def _sums(where: str = "TRUE") -> str:
    return _SUMS.replace("W)", f"{where})").replace("W AND", f"{where} AND")


def _zeros() -> str:
    return ", ".join(f"coalesce({n}, 0){'::DECIMAL(38, 10)' if n == 'cost_sum' else '::BIGINT'} AS {n}" for n in _NAMES)


def _with(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {_LEDGER}{''.join(ctes)} {body}"


def _by(keys: str, rows: str = _rows(), select: str | None = None) -> str:
    return _with(f"SELECT {select or keys}, {_VIEW} FROM (SELECT {keys}, {_sums()} FROM rows GROUP BY {', '.join(str(i + 1) for i in range(keys.count(',') + 1))})", _META, rows)


_SESSIONS = """, evn AS (
  SELECT agent, actor_id AS sid, t_ns, id, 1 AS sub, CASE WHEN agent <> 'codex' OR role = '' THEN 'blank' ELSE role END AS ekind, CASE WHEN agent = 'codex' AND role = 'subagent' THEN parent_agent ELSE '' END AS eparent,
    CASE WHEN agent = 'codex' AND role = 'main' THEN actor_id WHEN agent = 'codex' AND role = 'subagent' THEN session ELSE '' END AS eroot, p_kind, p_path, p_name FROM rows WHERE actor_id <> ''
  UNION ALL
  SELECT agent, session, t_ns, id, 0, 'root', '', session, p_kind, p_path, p_name FROM rows WHERE agent = 'codex' AND role = 'subagent' AND session <> ''
), firsts AS (
  SELECT * FROM evn QUALIFY row_number() OVER (PARTITION BY agent, sid ORDER BY t_ns, id, sub) = 1
), told AS (
  SELECT * FROM evn WHERE ekind IN ('main', 'subagent') QUALIFY row_number() OVER (PARTITION BY agent, sid ORDER BY t_ns, id, sub) = 1
), named AS (
  SELECT * FROM evn WHERE ekind IN ('main', 'subagent', 'root') QUALIFY row_number() OVER (PARTITION BY agent, sid ORDER BY t_ns, id, sub) = 1
), tot AS (
  SELECT agent, actor_id AS sid, min(t_ns) AS first_usage, max(t_ns) AS last_usage, SUMS FROM rows WHERE actor_id <> '' AND NOT (agent = 'codex' AND role = 'unknown') GROUP BY 1, 2
), acts AS (SELECT DISTINCT agent, sid FROM evn WHERE sub = 1),
base AS (
  SELECT f.agent, f.sid, f.ekind AS fk, f.p_kind AS fpk, f.p_path AS fpp, f.p_name AS fpn, m.id IS NOT NULL AS known, m.*EXCLUDE (agent, id),
    CASE WHEN f.ekind = 'unknown' THEN CASE WHEN m.id IS NULL THEN 'unknown' ELSE m.role END ELSE '' END AS start
  FROM firsts f LEFT JOIN meta m ON m.agent = f.agent AND m.id = f.sid
), made AS (
  SELECT b.*, CASE WHEN b.start = 'unknown' THEN n.ekind ELSE t.ekind END AS bk, CASE WHEN b.start = 'unknown' THEN n.eparent ELSE t.eparent END AS bp, CASE WHEN b.start = 'unknown' THEN n.eroot ELSE t.eroot END AS br
  FROM base b LEFT JOIN told t ON t.agent = b.agent AND t.sid = b.sid LEFT JOIN named n ON n.agent = b.agent AND n.sid = b.sid
), rowses AS (
  SELECT d.agent, d.sid AS id, known AS matched, coalesce(title, '') AS title, coalesce(nickname, '') AS nickname,
    CASE WHEN d.agent <> 'codex' THEN '' WHEN fk = 'root' THEN 'main' WHEN coalesce(role, '') IN ('main', 'subagent') THEN role WHEN bk = 'root' THEN 'main' WHEN bk IS NOT NULL THEN bk ELSE start END AS role,
    CASE WHEN d.agent <> 'codex' THEN '' WHEN fk = 'root' OR coalesce(role, '') IN ('main', 'subagent') THEN coalesce(parent_session, '') WHEN bk = 'subagent' THEN bp ELSE coalesce(parent_session, '') END AS parent_session,
    CASE WHEN d.agent <> 'codex' THEN '' WHEN fk = 'root' THEN d.sid WHEN coalesce(role, '') IN ('main', 'subagent') THEN coalesce(root_session, '') WHEN bk IS NOT NULL THEN br ELSE coalesce(root_session, '') END AS root_session,
    CASE WHEN known THEN kind WHEN fk <> 'root' THEN fpk ELSE 'unknown' END AS kind, CASE WHEN known THEN path WHEN fk <> 'root' THEN fpp ELSE '' END AS path, CASE WHEN known THEN name WHEN fk <> 'root' THEN fpn ELSE '' END AS name,
    last_ns, a.sid IS NOT NULL AS has_rows, t.first_usage, t.last_usage, ZEROS
  FROM made d LEFT JOIN tot t ON t.agent = d.agent AND t.sid = d.sid LEFT JOIN acts a ON a.agent = d.agent AND a.sid = d.sid
), onlymeta AS (
  SELECT m.agent, m.id, TRUE AS matched, title, nickname, role, parent_session, root_session, kind, path, name, last_ns, FALSE AS has_rows, NULL::BIGINT AS first_usage, NULL::BIGINT AS last_usage, NOTHING
  FROM meta m WHERE agent <> 'codex' AND last_ns IS NOT NULL AND strftime(make_timestamp(last_ns // 1000), '%Y-%m-%d') BETWEEN DAY1 AND DAY2 AND AGENTS
    AND NOT EXISTS (SELECT 1 FROM rowses r WHERE r.agent = m.agent AND r.id = m.id)
), every AS (SELECT * FROM rowses UNION ALL BY NAME SELECT * FROM onlymeta
), roots AS (SELECT DISTINCT root_session AS root FROM every WHERE agent = 'codex' AND role = 'subagent' AND root_session <> ''
), sess AS (
  SELECT e.* REPLACE (CASE WHEN r.root IS NOT NULL AND e.role IN ('', 'unknown') THEN 'main' ELSE e.role END AS role, CASE WHEN r.root IS NOT NULL AND e.role IN ('', 'unknown') THEN e.id ELSE e.root_session END AS root_session)
  FROM every e LEFT JOIN roots r ON e.agent = 'codex' AND e.id = r.root
  UNION ALL BY NAME
  SELECT m.agent, m.id, TRUE AS matched, title, nickname, 'main' AS role, parent_session, m.id AS root_session, kind, path, name, NULL::BIGINT AS last_ns, FALSE AS has_rows, NULL::BIGINT AS first_usage, NULL::BIGINT AS last_usage, NOTHING
  FROM meta m JOIN roots r ON m.id = r.root WHERE m.agent = 'codex' AND NOT EXISTS (SELECT 1 FROM every e WHERE e.agent = 'codex' AND e.id = r.root)
)"""


def _sessions(first: str = "'0000-01-01'", last: str = "'9999-12-31'", agents: str = "TRUE") -> str:
    nothing = ", ".join(f"0::{'DECIMAL(38, 10)' if n == 'cost_sum' else 'BIGINT'} AS {n}" for n in _NAMES)
    text = _SESSIONS.replace("SUMS", _sums()).replace("ZEROS", _zeros()).replace("NOTHING", nothing)
    return text.replace("DAY1", first).replace("DAY2", last).replace("AGENTS", agents)


_THREADS = """, acting AS (SELECT * FROM sess WHERE agent = 'codex'),
rt0 AS (
  SELECT r.*, s.role AS s_role, s.kind AS s_kind, s.path AS s_path, a.id AS actor, a.parent_session AS a_parent, a.title AS a_title, a.nickname AS a_nick, a.kind AS a_kind, a.path AS a_path,
    r.agent = 'codex' AND r.role = 'subagent' AS csub, r.agent = 'claude' AND r.subagent <> '' AS clsub,
    CASE WHEN r.agent = 'codex' AND r.role = 'subagent' THEN CASE WHEN r.session <> '' THEN r.session WHEN coalesce(a.root_session, '') <> '' THEN a.root_session ELSE r.subagent END END AS anchor,
    CASE WHEN r.agent = 'codex' AND r.role = 'unknown' THEN CASE WHEN r.session <> '' THEN r.session ELSE r.resolved_id END WHEN r.agent = 'codex' AND r.role = '' AND s.role <> '' THEN r.resolved_id END AS seeks
  FROM rows r JOIN sess s ON s.agent = r.agent AND s.id = r.resolved_id LEFT JOIN acting a ON r.agent = 'codex' AND r.role = 'subagent' AND a.id = r.subagent
), writes AS (
  SELECT anchor AS of, pos, anchor FROM rt0 WHERE csub UNION SELECT subagent, pos, anchor FROM rt0 WHERE csub
), latest AS (
  SELECT r.id, arg_max(w.anchor, w.pos) AS anchor FROM rt0 r JOIN writes w ON w.of = r.seeks AND w.pos < r.pos GROUP BY r.id
), init AS (
  SELECT of, max(start) AS start FROM (
    SELECT root_session AS of, root_session AS start FROM acting WHERE role = 'subagent' AND root_session <> ''
    UNION ALL SELECT id, CASE WHEN role = 'subagent' AND root_session <> '' THEN root_session ELSE id END FROM acting
      WHERE id NOT IN (SELECT root_session FROM acting WHERE role = 'subagent' AND root_session <> '')) GROUP BY of
), rt AS (
  SELECT r.*, coalesce(l.anchor, i.start) AS mapped,
    CASE WHEN r.agent = 'codex' AND r.role = 'main' THEN r.session WHEN csub THEN r.anchor WHEN seeks IS NOT NULL THEN coalesce(l.anchor, i.start, seeks) ELSE resolved_id END AS session_id,
    CASE WHEN clsub THEN subagent WHEN r.agent = 'codex' AND r.role = 'main' THEN r.session WHEN csub THEN subagent WHEN seeks IS NOT NULL THEN seeks ELSE resolved_id END AS thread_id,
    CASE WHEN seeks IS NOT NULL THEN 'unknown' WHEN r.agent = 'codex' AND r.role = '' AND r.kind IN ('collab_spawn', 'thread_spawn', 'agent_job') THEN 'legacy' ELSE 'own' END AS bucket
  FROM rt0 r LEFT JOIN latest l ON l.id = r.id LEFT JOIN init i ON i.of = r.seeks
), adds AS (
  SELECT agent, CASE WHEN agent = 'codex' AND role = 'subagent' AND root_session <> '' THEN root_session ELSE id END AS session_id, id AS thread_id,
    CASE WHEN agent = 'codex' AND role IN ('subagent', 'unknown') THEN role ELSE 'main' END AS type, title, nickname, kind, path, CASE WHEN agent = 'codex' AND role = 'subagent' THEN parent_session ELSE '' END AS parent, 0 AS n, 0 AS pos FROM sess
  UNION ALL SELECT DISTINCT 'codex', root_session, root_session, 'main', '', '', '', '', '', 1, 0 FROM acting WHERE role = 'subagent' AND root_session <> ''
  UNION ALL SELECT agent, session_id, thread_id, 'subagent', coalesce(a_title, ''), coalesce(a_nick, ''), CASE WHEN clsub THEN s_kind WHEN actor IS NOT NULL THEN a_kind ELSE p_kind END,
    CASE WHEN clsub THEN s_path WHEN actor IS NOT NULL THEN a_path ELSE p_path END, '', 2, pos FROM rt WHERE clsub OR csub
  UNION ALL SELECT agent, session_id, session_id, 'main', '', '', '', '', '', 2, pos FROM rt WHERE agent = 'codex' AND (role = 'main' OR (csub AND session_id <> thread_id))
  UNION ALL SELECT agent, session_id, thread_id, 'unknown', '', '', '', '', '', 2, pos FROM rt WHERE seeks IS NOT NULL AND mapped IS NULL
), par AS (
  SELECT agent, session_id, thread_id, CASE WHEN count(DISTINCT p) = 1 THEN min(p) ELSE '' END AS given FROM (
    SELECT agent, session_id, thread_id, parent_agent AS p FROM rt WHERE clsub OR csub UNION ALL SELECT agent, session_id, thread_id, coalesce(a_parent, '') FROM rt WHERE csub) WHERE p <> '' GROUP BY 1, 2, 3
), th AS (
  SELECT x.agent, x.session_id, x.thread_id, CASE WHEN first_type = 'unknown' AND a_main THEN 'main' ELSE first_type END AS type, title, nickname, kind, path, coalesce(p.given, x.parent) AS parent FROM (
    SELECT agent, session_id, thread_id, first(type ORDER BY n, pos) AS first_type, bool_or(type = 'main') AS a_main, coalesce(first(title ORDER BY n, pos) FILTER (title <> ''), '') AS title,
      coalesce(first(nickname ORDER BY n, pos) FILTER (nickname <> ''), '') AS nickname, coalesce(first(kind ORDER BY n, pos) FILTER (kind <> 'unknown'), 'unknown') AS kind,
      coalesce(first(path ORDER BY n, pos) FILTER (kind <> 'unknown'), '') AS path, coalesce(first(parent ORDER BY n, pos) FILTER (parent <> ''), '') AS parent FROM adds GROUP BY 1, 2, 3) x
  LEFT JOIN par p ON p.agent = x.agent AND p.session_id = x.session_id AND p.thread_id = x.thread_id
), reach AS (
  SELECT agent, session_id, thread_id AS top, thread_id FROM th WHERE type = 'subagent'
  UNION
  SELECT r.agent, r.session_id, r.top, t.thread_id FROM reach r JOIN th t ON t.agent = r.agent AND t.session_id = r.session_id AND t.type = 'subagent' AND t.parent = r.thread_id AND t.parent <> ''
)"""

_R = "rm_calls rm_errors rm_retried rm_decode_ms rm_decode_out rm_samples rm_ttft_ms rm_ttft_n".split()
_RSUMS = """count(*) FILTER (W AND NOT handed_on) AS rm_calls, count(*) FILTER (W AND NOT handed_on AND failed) AS rm_errors, count(*) FILTER (W AND NOT handed_on AND NOT failed AND tries > 1) AS rm_retried,
  coalesce(sum(m_win) FILTER (W), 0)::BIGINT AS rm_decode_ms, coalesce(sum(m_tok) FILTER (W), 0)::BIGINT AS rm_decode_out, count(m_tok) FILTER (W) AS rm_samples,
  coalesce(sum(ttft_ms) FILTER (W AND NOT failed AND ttft_ms > 0), 0)::BIGINT AS rm_ttft_ms, count(*) FILTER (W AND NOT failed AND ttft_ms > 0) AS rm_ttft_n"""
_RVIEW = "CASE WHEN rm_samples > 0 AND rm_decode_ms > 0 THEN round(rm_decode_out * 1000.0::DOUBLE / rm_decode_ms, 9) END AS metric_speed, CASE WHEN rm_ttft_n > 0 THEN round(rm_ttft_ms / rm_ttft_n / 1000, 9) END AS mean_ttft_s"


def _rollup() -> str:
    """rolled: per thread and measure self_, sub_, unknown_ and their sum."""
    names = [*_NAMES, *_R]
    all_sums = f"{_sums()}, {_RSUMS.replace('W)', 'TRUE)').replace('W AND', 'TRUE AND')}"
    key = "agent, session_id, thread_id"
    out = []
    for n in names:
        me = f"CASE WHEN t.type = 'unknown' THEN 0 ELSE coalesce(o.{n}, 0) END"
        sub = f"CASE WHEN t.type = 'unknown' THEN 0 ELSE coalesce(c.own_{n}, 0) + CASE WHEN t.type = 'main' THEN coalesce(l.{n}, 0) ELSE 0 END END"
        lost = f"coalesce(u.{n}, 0) + CASE WHEN t.type = 'unknown' THEN 0 ELSE coalesce(c.unk_{n}, 0) END"
        kind = "DECIMAL(38, 10)" if n == "cost_sum" else "BIGINT"
        out.append(f"({me})::{kind} AS self_{n}, ({sub})::{kind} AS sub_{n}, ({lost})::{kind} AS unknown_{n}, (({me}) + ({sub}) + ({lost}))::{kind} AS {n}")
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ("agent", "session_id", "thread_id"))
    return f""", used AS (SELECT {key}, bucket, {all_sums} FROM rt GROUP BY 1, 2, 3, 4),
uo AS (SELECT * FROM used WHERE bucket = 'own'), uu AS (SELECT * FROM used WHERE bucket = 'unknown'),
ul AS (SELECT agent, session_id, {", ".join(f"sum({n}) AS {n}" for n in names)} FROM used WHERE bucket = 'legacy' GROUP BY 1, 2),
pairs AS (
  SELECT m.agent, m.session_id, m.thread_id AS top, s.thread_id FROM th m JOIN th s ON s.agent = m.agent AND s.session_id = m.session_id AND s.type = 'subagent' WHERE m.type = 'main'
  UNION ALL SELECT agent, session_id, top, thread_id FROM reach WHERE top <> thread_id
), kids AS (
  SELECT p.agent, p.session_id, p.top, count(*) AS n_children, {", ".join(f"sum(o.{n}) AS own_{n}, sum(u.{n}) AS unk_{n}" for n in names)}
  FROM pairs p LEFT JOIN uo o ON {same("p", "o")} LEFT JOIN uu u ON {same("p", "u")} GROUP BY 1, 2, 3
), rolled AS (
  SELECT t.agent, t.session_id, t.thread_id, t.type, t.title, coalesce(c.n_children, 0) AS n_children, {", ".join(out)}
  FROM th t LEFT JOIN uo o ON {same("t", "o")} LEFT JOIN uu u ON {same("t", "u")} LEFT JOIN kids c ON c.agent = t.agent AND c.session_id = t.session_id AND c.top = t.thread_id
  LEFT JOIN ul l ON l.agent = t.agent AND l.session_id = t.session_id
), activity AS (
  SELECT agent, CASE WHEN seeks IS NOT NULL OR csub THEN session_id ELSE resolved_id END AS session_id, max(t_ns) AS row_time, count(DISTINCT subagent) FILTER (clsub) AS n_claude FROM rt GROUP BY 1, 2
), confirmed AS (
  SELECT id FROM sess WHERE agent = 'codex' AND role = 'main' UNION SELECT root_session FROM sess WHERE agent = 'codex' AND role = 'subagent' AND root_session <> ''
  UNION SELECT session_id FROM rt WHERE agent = 'codex' AND (role = 'main' OR (csub AND session_id <> thread_id))
), childlast AS (SELECT root_session AS id, max(last_ns) AS last_ns FROM sess WHERE agent = 'codex' AND role = 'subagent' GROUP BY 1
), items AS (
  SELECT r.*, coalesce(a.row_time, CASE WHEN r.agent = 'codex' AND r.type = 'main' THEN cl.last_ns END, s.last_ns) AS last_activity, a.row_time IS NOT NULL OR coalesce(s.has_rows, FALSE) AS has_usage_rows,
    CASE WHEN r.agent <> 'codex' THEN coalesce(a.n_claude, 0) WHEN r.type = 'main' AND cf.id IS NOT NULL THEN n_children END AS subagent_count
  FROM rolled r LEFT JOIN activity a ON a.agent = r.agent AND a.session_id = r.session_id LEFT JOIN childlast cl ON r.agent = 'codex' AND cl.id = r.thread_id
  LEFT JOIN sess s ON s.agent = r.agent AND s.id = r.thread_id LEFT JOIN confirmed cf ON r.agent = 'codex' AND cf.id = r.thread_id
  WHERE NOT (r.type = 'subagent' AND EXISTS (SELECT 1 FROM th m WHERE m.type = 'main' AND m.agent = r.agent AND m.session_id = r.session_id AND m.thread_id = r.session_id))
)"""


_SESSION_COLUMNS = "agent, id, matched, title, nickname, role, parent_session, root_session, kind, path, name, last_ns // 1000000 AS last_ms, has_rows, first_usage // 1000000 AS first_usage_ms, last_usage // 1000000 AS last_usage_ms"


def _threads(rows: str = _rows(), sessions: str | None = None) -> tuple[str, ...]:
    return (_META, rows, sessions or _sessions(), _THREADS)


_SUMMARY_INNER = f"SELECT {', '.join(f'sum({n}) AS {n}' for n in [*_NAMES, *_R])}, count(*) AS sessions, count(*) FILTER (unpriced > 0) AS unpriced_sessions, quantile_disc(CASE WHEN input + output > 0 THEN input + output END, 0.5) AS median, quantile_disc(CASE WHEN input + output > 0 THEN input + output END, 0.9) AS p90 FROM items"
_SUMMARY_INNER = _SUMMARY_INNER.replace("sum(cost_sum)", "sum(cost_sum)::DECIMAL(38, 10)")
for _n in (*_NAMES, *_R):
    if _n != "cost_sum":
        _SUMMARY_INNER = _SUMMARY_INNER.replace(f"sum({_n}) AS", f"sum({_n})::BIGINT AS")

_TOP = "WITH each AS (SELECT strftime(ts, '%Y-%m-%d') AS local_day, 'PREFIX' || (json_extract_string(props, '$.k')::BIGINT % MOD) AS name, count(*) AS n FROM events GROUP BY 1, 2), ranked AS (SELECT name, row_number() OVER (ORDER BY sum(n) DESC, name) AS rank FROM each GROUP BY name), top AS (SELECT name, CASE WHEN rank <= KEEP THEN name ELSE '__other__' END AS label, least(rank, KEEP + 1)::INTEGER AS rank FROM ranked), series AS (SELECT local_day, label, rank, sum(n)::BIGINT AS n FROM each JOIN top USING (name) GROUP BY 1, 2, 3) "


def _top(prefix: str, mod: int, keep: int) -> str:
    return _TOP.replace("PREFIX", prefix).replace("MOD", str(mod)).replace("KEEP", str(keep))




def _day(n: int) -> str:
    """So many days after the first of the ledger."""
    return f"(SELECT strftime(min(local_day)::DATE + {n}, '%Y-%m-%d') FROM led)"


_LABEL = "coalesce(first({name} ORDER BY pos) FILTER ({name} <> '' AND {name} <> {key}), {key})"

ORACLES = {
    "model_distribution": _by("model_name"),
    "project_distribution": _by("kind, path", _rows().replace("AS pos\n", "AS pos\n"), None).replace("SELECT kind, path, count(*)", "SELECT p_kind AS kind, CASE WHEN p_kind = 'project' THEN p_path ELSE '' END AS path, count(*)"),
    "request_metrics": _with(f"SELECT agent, rm_calls, rm_errors, rm_retried, rm_samples, rm_ttft_n, {_RVIEW} FROM (SELECT agent, {_RSUMS.replace('W)', 'TRUE)').replace('W AND', 'TRUE AND')} FROM rows GROUP BY agent)", _META, _rows()),
    "usage_by_day": _with(f"SELECT local_day, {_VIEW} FROM (SELECT d.local_day, {_zeros()} FROM (SELECT strftime(unnest(generate_series(min(local_day)::DATE, max(local_day)::DATE, INTERVAL 1 DAY)), '%Y-%m-%d') AS local_day FROM rows) d LEFT JOIN (SELECT local_day, {_sums()} FROM rows GROUP BY local_day) USING (local_day))", _META, _rows()),
    "usage_shares": _with("""SELECT *, round(total / sum(total) OVER (PARTITION BY dimension), 9) AS share FROM (
      SELECT d AS dimension, k1 AS key, k2 AS model, count(*) AS calls, sum(input + cache_read + cache_write + output)::BIGINT AS total, round(sum(cost)::DOUBLE, 6) AS cost, count(*) FILTER (input + output > 0 AND NOT priced) AS unpriced
      FROM (SELECT *, 'agent' AS d, agent AS k1, '' AS k2 FROM rows UNION ALL SELECT *, 'model', provider, model_name FROM rows UNION ALL SELECT *, 'source', source, '' FROM rows UNION ALL SELECT *, 'account', account, '' FROM rows UNION ALL SELECT *, 'caller', caller, '' FROM rows) GROUP BY 1, 2, 3)""", _META, _rows()),
    "session_totals": _with(f"SELECT {_SESSION_COLUMNS}, {_VIEW}, row_number() OVER (ORDER BY agent, id) AS position FROM sess", _META, _rows(), _sessions()),
    "session_model_effort": _with(f"SELECT agent, session_id, model_name, effort, {_VIEW}, row_number() OVER (PARTITION BY agent, session_id ORDER BY model_name, effort) AS place FROM (SELECT agent, actor_id AS session_id, model_name, effort, {_sums()} FROM rows WHERE actor_id <> '' AND NOT (agent = 'codex' AND role = 'unknown') GROUP BY 1, 2, 3, 4)", _META, _rows()),
    "filter_options_agents": _with(f"SELECT s.agent, coalesce(display_name, s.agent) AS display_name, row_number() OVER (ORDER BY s.agent) AS position FROM (SELECT DISTINCT agent FROM sess WHERE agent <> '') s LEFT JOIN (SELECT agent, {_LABEL.format(name='agent_name', key='agent')} AS display_name FROM rows GROUP BY agent) r USING (agent)", _META, _rows(), _sessions()),
    "filter_options_models": _with(f"SELECT provider, model_name, {_LABEL.format(name='provider_name', key='provider')} AS display_name, row_number() OVER (ORDER BY provider, model_name) AS position FROM rows WHERE provider <> '' GROUP BY provider, model_name", _META, _rows()),
    "filter_options_projects": _with("SELECT *, row_number() OVER (ORDER BY kind_order, path) AS position FROM (SELECT *, CASE kind WHEN 'project' THEN 0 WHEN 'workspace' THEN 1 WHEN 'projectless' THEN 2 ELSE 3 END AS kind_order FROM (SELECT DISTINCT kind, CASE WHEN kind = 'project' THEN path ELSE '' END AS path, CASE WHEN kind = 'project' THEN name ELSE '' END AS name FROM sess))", _META, _rows(), _sessions()),
    "agent_filter": _by("model_name", _rows("i.fam IN ('claude', 'gemini')")),
    "day_range": _by("model_name", _rows("local_day::DATE BETWEEN (SELECT min(local_day)::DATE + 4 FROM led) AND (SELECT max(local_day)::DATE - 10 FROM led)")),
    "model_pair_filter": _by("kind, path", _rows("(provider = 'p1' AND model_name = 'm3') OR (provider = 'p2' AND model_name = '未知模型')")).replace("SELECT kind, path, count(*)", "SELECT p_kind AS kind, CASE WHEN p_kind = 'project' THEN p_path ELSE '' END AS path, count(*)"),
    "project_filter": _by("model_name", _rows(project="coalesce(a.kind, b.kind, 'unknown') = 'workspace' OR (coalesce(a.kind, b.kind) = 'project' AND coalesce(a.path, b.path) = '/work/alpha')")),
    "session_identity": _with(f"SELECT id, fam AS agent, rejected OR (provider = '' AND status >= 400) AS rejected, {_IDENTITY} FROM led"),
    "project_classification": _with(f"SELECT agent, id, CASE WHEN cwd = '' THEN '.' ELSE cwd END AS cleaned, CASE WHEN cwd = '' THEN '.' ELSE cwd END AS messy, {_PROJECT} AS kind, cwd AS path, CASE WHEN {_PROJECT} = 'project' THEN split_part(cwd, '/', -1) ELSE '' END AS name FROM ses", _META),
    "decode_samples": _with(f"SELECT id, tokens, win AS window_ms FROM ({_OWN})"),
    "request_decode_samples": _with(f"SELECT id, tokens, win AS window_ms FROM ({_METRIC})"),
    "metadata_merge": _with("SELECT * FROM meta0", _META),
    "metadata_only_sessions": _with("SELECT agent, id, title, kind, path, name, last_ns // 1000000 AS last_ms, has_rows FROM onlymeta", _META, _rows(f"local_day >= {_day(4)}"), _sessions(_day(4), "(SELECT max(local_day) FROM led)")),
    "supplemental_roots": _with("SELECT agent, id, role, root_session, kind, path, last_ns // 1000000 AS last_ms FROM sess WHERE agent = 'codex' AND NOT has_rows", _META, _rows(f"local_day = {_day(9)} AND ((provider = 'p1' AND model_name = 'm3') OR (provider = 'p0' AND model_name = 'm1'))"), _sessions(_day(9), _day(9), "FALSE")),
    "thread_usage": _with(f"SELECT agent, session_id, thread_id, bucket, first_usage // 1000000 AS first_usage_ms, last_usage // 1000000 AS last_usage_ms, {_VIEW} FROM (SELECT agent, session_id, thread_id, bucket, min(t_ns) AS first_usage, max(t_ns) AS last_usage, {_sums()} FROM rt GROUP BY 1, 2, 3, 4)", *_threads()),
    "thread_parents": _with("SELECT agent, session_id, thread_id, type, title, nickname, kind, path, parent FROM th", *_threads()),
    "thread_descendants": _with("SELECT * FROM reach WHERE top <> thread_id", *_threads()),
    "compaction_tokens": _with("SELECT agent, session_id, thread_id, model_name, effort, count(*) AS calls, CASE WHEN agent = 'codex' AND NOT bool_or(compaction IS NULL) THEN sum(CASE WHEN compaction THEN input + cache_read + cache_write + output ELSE 0 END)::BIGINT END AS compaction_tokens, row_number() OVER (PARTITION BY agent, session_id, thread_id ORDER BY sum(input + output) DESC, model_name, effort) AS place FROM rt WHERE bucket = 'own' GROUP BY agent, session_id, thread_id, model_name, effort", *_threads()),
    "session_list": _with(f"SELECT row_number() OVER (ORDER BY last_activity DESC NULLS LAST, agent, session_id, thread_id) AS position, agent, session_id, thread_id, type, title, last_activity // 1000000 AS last_activity_ms, has_usage_rows, subagent_count, self_calls, sub_calls, unknown_calls, self_input, sub_input, unknown_input, self_output, sub_output, unknown_output, {_VIEW} FROM items", *_threads(), _rollup()),
    "session_detail": _with(f"SELECT agent, session_id, thread_id, type, n_children, self_calls, sub_calls, unknown_calls, {_VIEW} FROM rolled", *_threads(), _rollup()),
    "summary": _with(f"SELECT sessions, unpriced_sessions, median, p90, {_RVIEW}, {_VIEW} FROM ({_SUMMARY_INNER})", *_threads(), _rollup()),
    "public_summary": _with(f"""SELECT input + cache_read + cache_write AS input_tokens, cache_read AS cached_tokens, input AS uncached_input_tokens, output AS output_tokens, reasoning AS reasoning_tokens, output - reasoning AS other_output_tokens,
      total AS total_tokens, cache_hit_rate, CASE WHEN total = 0 AND sessions = 0 THEN 0.0::DOUBLE WHEN unpriced = 0 OR cost > 0 THEN cost END AS estimated_cost, CASE WHEN (total = 0 AND sessions = 0) OR unpriced = 0 THEN 'complete' WHEN cost > 0 THEN 'partial' ELSE 'unknown' END AS cost_status,
      sessions AS session_count, sessions - unpriced_sessions AS complete_sessions FROM (SELECT sessions, unpriced_sessions, {_VIEW} FROM ({_SUMMARY_INNER}))""", *_threads(_rows("i.fam = 'codex'"), _sessions(agents="m.agent = 'codex'")), _rollup()),
    "share_top5_other": _with(f"""SELECT label, total, cost, unpriced, round(total * 100.0::DOUBLE / sum(total) OVER (), 6) AS percent FROM (SELECT label, sum(total)::BIGINT AS total, round(sum(cost), 6) AS cost, sum(unpriced)::BIGINT AS unpriced FROM (
      SELECT *, CASE WHEN row_number() OVER (ORDER BY total DESC, model_name) <= 5 THEN model_name ELSE '__other__' END AS label FROM (SELECT model_name, {_VIEW} FROM (SELECT model_name, {_sums()} FROM rows GROUP BY 1))) GROUP BY label)""", _META, _rows()),
    "share_top5_cost": _with(f"""SELECT label, total, cost, unpriced, round(cost * 100.0::DOUBLE / sum(cost) OVER (), 6) AS percent FROM (SELECT label, sum(total)::BIGINT AS total, round(sum(cost), 6) AS cost, sum(unpriced)::BIGINT AS unpriced FROM (
      SELECT *, CASE WHEN row_number() OVER (ORDER BY cost DESC, model_name) <= 5 THEN model_name ELSE '__other__' END AS label FROM (SELECT model_name, {_VIEW} FROM (SELECT model_name, {_sums()} FROM rows GROUP BY 1))) GROUP BY label)""", _META, _rows()),
    "series_top10_other": _top("skill-", 17, 10) + "SELECT d.local_day, l.label, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT local_day FROM each) d, (SELECT DISTINCT label FROM top) l LEFT JOIN series s ON s.local_day = d.local_day AND s.label = l.label",
    "running_stack": _top("skill-", 17, 10) + "SELECT local_day, label, rank, n, sum(n) OVER w::BIGINT AS upper, (sum(n) OVER w - n)::BIGINT AS lower FROM series WINDOW w AS (PARTITION BY local_day ORDER BY rank ROWS UNBOUNDED PRECEDING)",
    "tool_usage": _top("t", 13, 8) + "SELECT label, sum(n)::BIGINT AS calls FROM series GROUP BY label",
    "skill_labels": _top("skill-", 17, 17) + "SELECT DISTINCT name, 'Skill ' || split_part(name, '-', 2) AS label FROM each UNION ALL SELECT DISTINCT 'pack-x:' || name, 'Pack X: Skill ' || split_part(name, '-', 2) FROM each",
    "skills_of_day": _top("skill-", 17, 10) + "SELECT *, row_number() OVER (PARTITION BY local_day ORDER BY n DESC, label) AS place FROM series",
    "tool_usage_days": "SELECT 't' || (json_extract_string(props, '$.k')::BIGINT % 13) AS name, count(*) AS calls FROM events WHERE ts::DATE > (SELECT max(ts)::DATE - 7 FROM events) GROUP BY 1",
    "session_page": _with(f"SELECT agent, id, has_rows, sort_cost, position FROM (SELECT *, row_number() OVER (ORDER BY sort_cost DESC NULLS LAST, agent, id) AS position FROM (SELECT agent, id, has_rows, CASE WHEN has_rows THEN cost END AS sort_cost FROM (SELECT {_SESSION_COLUMNS}, {_VIEW} FROM sess))) WHERE position BETWEEN 7 AND 12", _META, _rows(), _sessions()),
    "kpi_ratios": _with(f"SELECT agent, round(total * 100.0::DOUBLE / sum(total) OVER (), 6) AS token_share, round((calls - errors) / calls, 9) AS success_rate, CASE WHEN total > 0 THEN round(cost * 1000000 / total, 6) END AS cost_per_million FROM (SELECT agent, {_VIEW} FROM (SELECT agent, {_sums()} FROM rows GROUP BY 1))", _META, _rows()),
    "range_resolution": """WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events), r AS (
      SELECT d, 'today' AS range, d AS a, d AS b FROM d UNION ALL SELECT d, 'yesterday', d - 1, d - 1 FROM d UNION ALL SELECT d, '7d', d - 6, d FROM d UNION ALL SELECT d, '30d', d - 29, d FROM d
      UNION ALL SELECT d, 'year', make_date(year(d), 1, 1), make_date(year(d), 12, 31) FROM d
      UNION ALL SELECT d, 'custom', d - 10, d - 2 FROM d WHERE day(d) % 5 <> 0)
      SELECT strftime(d, '%Y-%m-%d') AS today, range, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, epoch_ms(a::TIMESTAMP) AS start_ms, epoch_ms((b + 1)::TIMESTAMP) AS end_ms FROM r""",
    "quality_violations": _with("""SELECT 'blank session' AS rule, count(*) FILTER (session = '') AS n FROM led UNION ALL SELECT 'blank model', count(*) FILTER (model = '') FROM led UNION ALL SELECT 'no time to first token', count(*) FILTER (ttft_ms <= 0) FROM led
      UNION ALL SELECT 'reasoning above output', count(*) FILTER (reasoning > output) FROM led UNION ALL SELECT 'negative tokens', count(*) FILTER (input < 0 OR output < 0) FROM led UNION ALL SELECT 'unknown compaction', count(*) FILTER (compaction IS NULL) FROM led
      UNION ALL SELECT 'cost of an unpriced request', count(*) FILTER (NOT priced AND cost > 0) FROM led"""),
}
_ZONE_LIST = ", ".join(f"'{z}'" for z in ZONES)
ORACLES |= {
    "local_midnight": f"SELECT local_day, zone, epoch_ms(local_day::TIMESTAMP AT TIME ZONE zone) AS start_ms FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS local_day FROM events), (SELECT unnest([{_ZONE_LIST}]) AS zone)",
    "local_days": f"SELECT zone, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE zone, '%Y-%m-%d') AS day, count(*) AS n FROM events, (SELECT unnest([{_ZONE_LIST}]) AS zone) GROUP BY 1, 2",
}

_ENDS = """, ends AS (SELECT min(local_day)::DATE AS f, max(local_day)::DATE AS l FROM led)"""
_LATER = _ENDS + """, later AS (
  SELECT led.* REPLACE (CASE WHEN local_day::DATE - f IN (2, 28) THEN cost + 1 ELSE cost END AS cost) FROM led, ends WHERE NOT (local_day::DATE - f = 11 AND id % 20 = 0)
)"""
_DIGESTS = _LATER + """, was AS (
  SELECT local_day AS day, count(*) AS calls, sum(input) AS input, sum(cost::DECIMAL(38, 10)) AS cost, count(*) FILTER (input + output > 0 AND NOT priced) AS unpriced FROM led GROUP BY 1
), now AS (
  SELECT local_day AS day, count(*) AS calls, sum(input) AS input, sum(cost::DECIMAL(38, 10)) AS cost, count(*) FILTER (input + output > 0 AND NOT priced) AS unpriced FROM later GROUP BY 1
), differ AS (
  SELECT day, was.calls <> now.calls OR was.input <> now.input OR was.cost <> now.cost OR was.unpriced <> now.unpriced AS changed FROM was JOIN now USING (day)
)"""
_SNAPSHOTS = """, hashed AS MATERIALIZED (SELECT *, ('0x' || substr(md5(agent || id), 1, 4))::BIGINT AS h FROM ses
), old AS MATERIALIZED (SELECT *, h % 3 = 0 AS disappeared FROM hashed WHERE h % 11 <> 0
), new AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN h % 13 = 0 THEN '' WHEN h % 7 = 0 THEN 'moved' ELSE root_session END AS root_session, CASE WHEN h % 13 = 0 THEN '' ELSE role END AS role, CASE WHEN h % 13 = 0 THEN '' ELSE parent_session END AS parent_session,
    CASE WHEN h % 17 = 0 THEN 'edited' ELSE title END AS title) FROM hashed WHERE h % 5 <> 0
), pair AS (
  SELECT k.agent, k.id, n.id IS NOT NULL AS here, o.id IS NOT NULL AS had, coalesce(o.disappeared, FALSE) AS was_gone, n.title AS title, o.title AS o_title, n.cwd, n.nickname, n.start_ns, n.last_ns,
    o.cwd AS o_cwd, o.nickname AS o_nickname, o.start_ns AS o_start_ns, o.last_ns AS o_last_ns,
    n.role, n.parent_session, n.root_session, o.role AS o_role, o.parent_session AS o_parent, o.root_session AS o_root, n.role <> '' OR n.parent_session <> '' OR n.root_session <> '' AS tells
  FROM (SELECT agent, id FROM old UNION SELECT agent, id FROM new) k LEFT JOIN old o ON o.agent = k.agent AND o.id = k.id LEFT JOIN new n ON n.agent = k.agent AND n.id = k.id
), merged AS (
  SELECT agent, id, CASE WHEN here THEN title ELSE o_title END AS title, CASE WHEN here AND (tells OR NOT had) THEN role ELSE o_role END AS role, CASE WHEN here AND (tells OR NOT had) THEN parent_session ELSE o_parent END AS parent_session,
    CASE WHEN here AND (tells OR NOT had) THEN root_session ELSE o_root END AS root_session, NOT here AS disappeared, coalesce(o_start_ns, 1800000000000000000) // 1000000 AS first_seen_ms, CASE WHEN here THEN 1800000000000000000 ELSE o_last_ns END // 1000000 AS last_seen_ms,
    CASE WHEN here THEN cwd ELSE o_cwd END AS cwd, CASE WHEN here THEN nickname ELSE o_nickname END AS nickname, CASE WHEN here THEN start_ns ELSE o_start_ns END AS start_ns, CASE WHEN here THEN last_ns ELSE o_last_ns END AS last_ns
  FROM pair
), told_ids AS (
  SELECT DISTINCT unnest([id, o_parent, o_root, parent_session, root_session]) AS id FROM pair
  WHERE here AND agent = 'codex' AND tells AND (NOT had OR role <> o_role OR parent_session <> o_parent OR root_session <> o_root)
), told_days AS (
  SELECT DISTINCT local_day FROM led WHERE agent = 'codex' AND EXISTS (SELECT 1 FROM told_ids c WHERE c.id <> '' AND c.id IN (led.session, led.native_session, led.subagent, led.parent_agent))
)"""

ORACLES |= {
    "day_digest_changes": _with("SELECT day FROM differ WHERE changed", _DIGESTS),
    "refresh_decision": _with("""SELECT day, served, decision, decision = 'skip: freeze' OR (starts_with(decision, 'skip') AND n % 5 = 0) AS frozen FROM (
      SELECT day, n, served, CASE WHEN n % 16 = 0 THEN 'pull: compaction' WHEN n % 17 = 0 THEN 'pull: metrics' WHEN n % 9 = 0 THEN 'pull: identity' WHEN n % 11 = 0 THEN 'pull: never loaded'
        WHEN served AND n % 6 <> 1 AND changed THEN 'pull: changed' WHEN n % 5 = 0 THEN 'skip: frozen' WHEN day::DATE < l - 6 AND n % 7 <> 0 AND n % 13 <> 0 THEN 'skip: freeze'
        WHEN (n % 13 = 0 AND n % 7 <> 0) OR NOT served THEN 'pull: unverified' WHEN day::DATE >= l THEN 'pull: recent' WHEN day::DATE < l - 6 THEN 'pull: old' ELSE 'skip: same' END AS decision
      FROM (SELECT *, day(day::DATE) AS n FROM differ), ends, (VALUES (TRUE), (FALSE)) v(served))""", _DIGESTS),
    "snapshot_merge": _with("SELECT agent, id, title, role, parent_session, root_session, disappeared, first_seen_ms, last_seen_ms FROM merged", _META, _SNAPSHOTS),
    "session_changes": _with("""SELECT * FROM (SELECT agent, id, CASE WHEN NOT had THEN 'new' WHEN NOT here AND NOT was_gone THEN 'gone' WHEN here AND was_gone THEN 'back'
      WHEN here AND tells AND (role <> o_role OR parent_session <> o_parent OR root_session <> o_root) THEN 'moved'
      WHEN here AND (title <> o_title OR cwd <> o_cwd OR nickname <> o_nickname OR start_ns <> o_start_ns OR last_ns <> o_last_ns) THEN 'edited' END AS change FROM pair) WHERE change IS NOT NULL""", _META, _SNAPSHOTS),
    "changed_session_days": _with("SELECT local_day FROM told_days", _META, _SNAPSHOTS),
}

_QUOTAS = """WITH by_day AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 4 AS p, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS s, count(*) AS n FROM events GROUP BY 1, 2
), quotas AS (
  SELECT day, CASE p WHEN 0 THEN 'gemini' WHEN 1 THEN 'copilot' WHEN 2 THEN 'codex' ELSE 'claude' END AS provider, s, n,
    CASE WHEN n % 7 = 0 THEN 'reading failed' ELSE '' END AS error, epoch_ms(day::TIMESTAMP) AS start FROM by_day WHERE NOT (p = 2 AND n % 11 = 0)
)"""
ORACLES |= {
    "quota_cards": _QUOTAS + """, windows AS (
      SELECT day, provider, 0 AS delivered, CASE provider WHEN 'copilot' THEN 'chat' ELSE '5 hours' END AS name, s % 131 - 10 AS u FROM quotas
      UNION ALL SELECT day, provider, 1, CASE provider WHEN 'copilot' THEN 'Premium requests' ELSE '7 days' END, s % 97 FROM quotas
      UNION ALL SELECT day, provider, 2, CASE provider WHEN 'copilot' THEN 'completions' ELSE '5 hours' END, 1 FROM quotas
    ), shown AS (
      SELECT day, provider, name, greatest(0, least(100, u))::DOUBLE AS used, delivered, CASE provider WHEN 'codex' THEN 1 WHEN 'claude' THEN 2 WHEN 'copilot' THEN 3 ELSE 4 END AS rank FROM windows
      WHERE provider <> 'copilot' OR name ILIKE '%premium%'
    ) SELECT *, floor(100 - used + 0.5)::BIGINT AS remaining, CASE WHEN 100 - used >= 60 THEN 'high' WHEN 100 - used >= 20 THEN 'middle' ELSE 'low' END AS band,
      row_number() OVER (PARTITION BY day ORDER BY rank, provider, delivered) AS place FROM shown""",
    "public_quota": _QUOTAS + """, joined AS (
      SELECT d.day, CASE WHEN q.day IS NULL THEN 'auth_required' WHEN error <> '' THEN 'unavailable' ELSE 'ready' END AS status, s, n, start
      FROM (SELECT DISTINCT day FROM quotas) d LEFT JOIN (SELECT * FROM quotas WHERE provider = 'codex') q ON q.day = d.day
    ) SELECT day, status, CASE WHEN status = 'ready' THEN CASE WHEN n % 3 <> 0 THEN start + s % 86400 * 1000 WHEN n % 5 <> 0 THEN start + n % 86400 * 1000 END END AS fetched_ms,
      CASE WHEN status = 'ready' THEN (s % 131 - 10)::DOUBLE END AS five_hour_used, CASE WHEN status = 'ready' THEN (110 - s % 131)::DOUBLE END AS five_hour_remaining,
      CASE WHEN status = 'ready' AND s % 4 <> 0 THEN start + s % 90000 * 1000 END AS five_hour_reset_ms, CASE WHEN status = 'ready' THEN 18000 END AS five_hour_seconds,
      CASE WHEN status = 'ready' THEN (s % 97)::DOUBLE END AS weekly_used, CASE WHEN status = 'ready' THEN (100 - s % 97)::DOUBLE END AS weekly_remaining,
      CASE WHEN status = 'ready' AND s % 4 <> 0 THEN start + s % 90000 * 1000 END AS weekly_reset_ms, CASE WHEN status = 'ready' THEN 604800 END AS weekly_seconds FROM joined""",
    "quota_keeper": _QUOTAS + """ SELECT provider, max(day) FILTER (error = '') AS good_day, arg_max(error, day) AS error, arg_max((s % 131 - 10)::DOUBLE, day) FILTER (error = '') AS used FROM quotas GROUP BY provider""",
    "revision_feed": """WITH feed AS (
      SELECT user_id % 10 AS feed, event_id AS id, event_id // 97 - CASE WHEN json_extract_string(props, '$.k')::BIGINT % 25 = 3 THEN 2 ELSE 0 END AS data_revision, event_id // 1000 AS status_revision FROM events
    ), before AS (SELECT *, lag(data_revision) OVER w AS d, lag(status_revision) OVER w AS s FROM feed WINDOW w AS (PARTITION BY feed ORDER BY id))
    SELECT feed, id, data_revision, status_revision, CASE WHEN data_revision < d OR status_revision < s THEN 'epoch_reset' ELSE 'revision' END AS kind
    FROM before WHERE d IS NULL OR data_revision <> d OR status_revision <> s""",
}

_KIDS = """, kid AS (
  SELECT p.*, u.last_usage, row_number() OVER (PARTITION BY p.agent, p.session_id, p.top ORDER BY u.last_usage DESC NULLS LAST, p.thread_id) AS place FROM pairs p
  LEFT JOIN (SELECT agent, session_id, thread_id, max(t_ns) AS last_usage FROM rt WHERE bucket = 'own' GROUP BY 1, 2, 3) u ON u.agent = p.agent AND u.session_id = p.session_id AND u.thread_id = p.thread_id
), chosen AS (SELECT agent, session_id, thread_id FROM rolled ORDER BY n_children DESC, agent, session_id, thread_id LIMIT 1)"""
_NATURAL = "nullif(list_aggregate(list_transform(regexp_extract_all(lower(string_split(path, '/')[-1]), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), 'string_agg', ''), '')"
_SORTS = {"last_activity": "last_activity", "project": f"CASE WHEN kind = 'project' THEN {_NATURAL} END"} | {c: f"CASE WHEN has_usage_rows THEN {c} END" for c in ("total", "cost", "cache_hit_rate")}


def _pages() -> str:
    """The first and the last page by each field in both directions."""
    out = []
    for field, key in _SORTS.items():
        for down in (True, False):
            order = f"{key} {'DESC' if down else 'ASC'} NULLS LAST, agent || '|' || session_id || '|' || thread_id"
            ranked = f"SELECT agent, session_id, thread_id, row_number() OVER (ORDER BY {order}) AS position, count(*) OVER () AS n FROM priced"
            for last in (False, True):
                where = "position > (n - 1) // 6 * 6" if last else "position <= 6"
                out.append(f"SELECT '{field}' AS field, {str(down).upper()} AS descending, {str(last).upper()} AS last_page, agent, session_id, thread_id, position FROM ({ranked}) WHERE {where}")
    return " UNION ALL ".join(out)


ORACLES |= {
    "thread_children": _with("SELECT agent, session_id, top, thread_id, last_usage // 1000000 AS last_usage_ms, place FROM kid", *_threads(), _rollup(), _KIDS),
    "thread_detail": _with(f"""SELECT place, agent, session_id, thread_id, type, n_children, self_calls, sub_calls, unknown_calls, {_VIEW} FROM (
      SELECT 0 AS place, r.* FROM rolled r JOIN chosen USING (agent, session_id, thread_id)
      UNION ALL SELECT k.place, r.* FROM rolled r JOIN kid k ON k.agent = r.agent AND k.session_id = r.session_id AND k.thread_id = r.thread_id
        JOIN chosen c ON c.agent = k.agent AND c.session_id = k.session_id AND c.thread_id = k.top)""", *_threads(), _rollup(), _KIDS),
    "session_table": _with(_pages(), *_threads(), _rollup(), f", priced AS (SELECT i.agent, i.session_id, i.thread_id, t.kind, t.path, last_activity, has_usage_rows, {_VIEW} FROM items i JOIN th t ON t.agent = i.agent AND t.session_id = i.session_id AND t.thread_id = i.thread_id)"),
    "view_violations": _with(f"""SELECT unnest(['count that isn''t a safe integer', 'ratio out of 0 to 1', 'cost that isn''t finite', 'speed that isn''t finite', 'blank label', 'control character', 'checked']) AS rule,
      unnest([count(*) FILTER (least(calls, errors, retried, input, output, cache_read, cache_write, cache_write_1h, reasoning, unpriced, decode_n, total) < 0), count(*) FILTER (cache_hit_rate NOT BETWEEN 0 AND 1), count(*) FILTER (cost IS NULL OR cost < 0),
        count(*) FILTER (output_speed < 0), count(*) FILTER (agent = '' OR trim(model_name) = ''), count(*) FILTER (regexp_matches(model_name, '[\\x00-\\x1f]')), count(*)]) AS n
      FROM (SELECT agent, model_name, {_VIEW} FROM (SELECT agent, model_name, {_sums()} FROM rows GROUP BY 1, 2))""", _META, _rows()),
}

_STATE = """, days AS (SELECT DISTINCT local_day AS day FROM led), state AS (
  SELECT day, n % 7 <> 0 AS loaded, n AS row_count, CASE WHEN n % 7 <> 0 THEN 1700000000000000000 END AS last_sync_ns, n % 5 = 0 AS frozen, n % 3 = 0 AS identity_pending, n % 4 = 0 AS compaction_pending, n % 6 = 0 AS metrics_pending
  FROM (SELECT day, day(day::DATE) AS n FROM days WHERE day(day::DATE) % 8 <> 0 UNION ALL SELECT strftime(min(day)::DATE - 7, '%Y-%m-%d'), day(min(day)::DATE - 7) FROM days WHERE day(day::DATE) % 8 <> 0)
)"""
_SAVED = """CASE WHEN d.day IS NOT NULL THEN coalesce(s.day, d.day)::DATE < (SELECT max(day)::DATE - 4 FROM days) ELSE s.frozen END AS frozen, CASE WHEN d.day IS NOT NULL AND IDENTITY THEN FALSE ELSE coalesce(s.identity_pending, FALSE) END AS identity_pending,
  coalesce(s.compaction_pending, FALSE) AND d.day IS NULL AS compaction_pending, coalesce(s.metrics_pending, FALSE) AND d.day IS NULL AS metrics_pending"""
ORACLES |= {
    "landed_pages": _with("""SELECT day, max(pull)::BIGINT AS pull, count(*) AS pages, CASE WHEN bool_and(starts = due) AND min(total) = max(total) AND max(starts + size) = max(total) THEN max(total)::BIGINT END AS total FROM linked GROUP BY day""", """, each AS (SELECT local_day AS day, id // 1000 AS n, count(*) AS size FROM led GROUP BY 1, 2
    ), numbered AS (
      SELECT day, size, sum(size) OVER (PARTITION BY day ORDER BY n) - size AS "offset", sum(size) OVER (PARTITION BY day) AS total,
        row_number() OVER (PARTITION BY day ORDER BY n) AS nth, dayofmonth(day::DATE) % 7 AS kind FROM each
    ), pulls AS (SELECT *, 1 AS pull FROM numbered UNION ALL SELECT *, 2 FROM numbered WHERE kind IN (5, 6)
    ), pages AS (
      SELECT day, pull, "offset" - CASE WHEN nth = 2 AND kind = 2 THEN 1 ELSE 0 END AS starts, size - CASE WHEN nth = 2 AND kind = 4 THEN 1 ELSE 0 END AS size,
        total + CASE WHEN nth = 2 AND kind = 3 THEN 1 ELSE 0 END AS total
      FROM pulls WHERE NOT (nth = 2 AND (kind = 1 OR (kind = 5 AND pull = 1) OR (kind = 6 AND pull = 2)))
    ), latest AS (SELECT * FROM pages QUALIFY pull = max(pull) OVER (PARTITION BY day)
    ), linked AS (SELECT day, pull, starts, size, total, coalesce(lag(starts + size) OVER (PARTITION BY day ORDER BY starts), 0) AS due FROM latest)"""),
    "candidate_days": _with("SELECT strftime(unnest(generate_series((SELECT min(day)::DATE FROM days WHERE day(day::DATE) > 9), (SELECT max(day)::DATE + 3 FROM days), INTERVAL 1 DAY)), '%Y-%m-%d') AS day UNION SELECT day FROM state", _STATE),
    "verified_days": _with("SELECT day, n % 4 <> 0 AND n % 6 <> 0 AS ok FROM (SELECT day, day(day::DATE) AS n FROM days)", _STATE),
    "backfill_flags": _with(f"""SELECT step, count(*) AS days, count(*) FILTER (last_sync_ns IS NULL) AS never_loaded, count(*) FILTER (frozen) AS frozen, count(*) FILTER (identity_pending) AS identity_pending,
      count(*) FILTER (compaction_pending) AS compaction_pending, count(*) FILTER (metrics_pending) AS metrics_pending FROM (
      SELECT 'before' AS step, * FROM state UNION ALL BY NAME SELECT 'queued' AS step, * FROM queued UNION ALL BY NAME
      SELECT 'saved' AS step, CASE WHEN d.day IS NOT NULL THEN 1 ELSE s.last_sync_ns END AS last_sync_ns, {_SAVED.replace("IDENTITY", "TRUE")} FROM queued s FULL JOIN (SELECT day FROM days WHERE day(day::DATE) % 2 = 0) d ON s.day = d.day) GROUP BY step""",
      _STATE, """, hit AS (SELECT DISTINCT local_day AS day FROM led WHERE agent = 'codex' AND EXISTS (SELECT 1 FROM (SELECT DISTINCT 'a' || u AS id FROM led WHERE agent = 'codex' AND u % 10 = 7) c
        WHERE c.id IN (led.session, led.native_session, led.subagent, led.parent_agent))
      ), queued AS (
        SELECT coalesce(s.day, h.day) AS day, s.last_sync_ns, coalesce(s.frozen, FALSE) AS frozen, coalesce(s.identity_pending, FALSE) OR h.day IS NOT NULL AS identity_pending, coalesce(s.compaction_pending, FALSE) AS compaction_pending,
          coalesce(s.metrics_pending, FALSE) AS metrics_pending FROM state s FULL JOIN hit h ON s.day = h.day)"""),
    "day_states": _with(f"""SELECT coalesce(s.day, d.day) AS day, d.day IS NOT NULL OR loaded AS loaded, CASE WHEN d.day IS NOT NULL THEN d.n ELSE s.row_count END AS row_count, CASE WHEN d.day IS NOT NULL THEN 4000000000000000000 ELSE s.last_sync_ns END AS last_sync_ns,
      {_SAVED.replace("IDENTITY", "FALSE")} FROM state s FULL JOIN (SELECT local_day AS day, count(*) AS n FROM led WHERE day(local_day::DATE) % 2 = 0 GROUP BY 1) d ON s.day = d.day""", _STATE),
}
#: The ledger and session metadata that the load's story ends with: two days replaced, the later sessions merged.
_LOADED = _LATER.replace("later AS", "later0 AS") + _SNAPSHOTS + """, later AS (
  SELECT x.* FROM later0 x, ends WHERE x.local_day::DATE - f IN (2, 11) UNION ALL SELECT x.* FROM led x, ends WHERE x.local_day::DATE - f NOT IN (2, 11)
)"""
_LOADED_META = _META[_META.index(", meta0 AS") :].replace("FROM ses ", "FROM merged ").replace("meta0", "lmeta0").replace("meta AS", "lmeta AS").replace("FROM meta0", "FROM lmeta0")
_LOADED_ROWS = _rows().replace("FROM led", "FROM later").replace("JOIN meta ", "JOIN lmeta ")
_LOADED_SESSIONS = _sessions().replace("JOIN meta ", "JOIN lmeta ").replace("FROM meta ", "FROM lmeta ")
_PART = "SELECT '{0}' AS report, {1} AS key, calls, errors, input, output, decode_n, cost, total, output_speed FROM ({2})"
ORACLES |= {
    "load_story": _with("""SELECT s.step, d.day, CASE WHEN s.step >= 3 AND d.day::DATE - f = 11 THEN d.n - d.lost ELSE d.n END AS row_count, s.step >= 2 AND t.local_day IS NOT NULL AND NOT (s.step >= 3 AND d.day::DATE - f IN (2, 11)) AND NOT (s.step = 7 AND d.day::DATE = l) AS identity_pending,
        d.day::DATE < l - 7 AS frozen, (s.step >= 3 AND d.day::DATE - f = 28 AND NOT (s.step = 7 AND d.day::DATE = l)) OR (s.step >= 6 AND d.day::DATE = l - 1) AS waits, (s.step >= 5 AND d.day::DATE = l - 1) OR (s.step BETWEEN 5 AND 6 AND d.day::DATE = l) AS recent,
        1 + (SELECT count(*) FROM days) + 1 + (s.step >= 2)::INT + CASE WHEN s.step >= 3 THEN 2 ELSE 0 END + CASE WHEN s.step >= 7 THEN 1 ELSE 0 END AS revision, TRUE AS complete
      FROM (SELECT local_day AS day, count(*) AS n, count(*) FILTER (id % 20 = 0) AS lost FROM led GROUP BY 1) d, ends, (SELECT unnest(range(1, 8))::INT AS step) s LEFT JOIN told_days t ON t.local_day = d.day""", _META, _ENDS, _SNAPSHOTS, ", days AS (SELECT DISTINCT local_day AS day FROM led)"),
    "reports_after_reload": _with(" UNION ALL ".join([
        _PART.format("model", "model_name", f"SELECT model_name, {_VIEW} FROM (SELECT model_name, {_sums()} FROM rows GROUP BY 1)"),
        _PART.format("project", "kind || '|' || path", f"SELECT kind, path, {_VIEW} FROM (SELECT p_kind AS kind, CASE WHEN p_kind = 'project' THEN p_path ELSE '' END AS path, {_sums()} FROM rows GROUP BY 1, 2)"),
        _PART.format("day", "local_day", f"SELECT local_day, {_VIEW} FROM (SELECT local_day, {_sums()} FROM rows GROUP BY 1)"),
        _PART.format("session", "concat_ws('|', agent, id, title, role, root_session, kind, path, first_usage_ms, last_usage_ms)", f"SELECT {_SESSION_COLUMNS}, {_VIEW} FROM sess"),
    ]), _META, _LOADED, _LOADED_META, _LOADED_ROWS, _LOADED_SESSIONS),
    "stored_threads": _with(ORACLES["thread_usage"].partition(_THREADS)[2], _META, _LOADED, _LOADED_META, _LOADED_ROWS, _LOADED_SESSIONS, _THREADS.replace("JOIN meta ", "JOIN lmeta ").replace("FROM meta ", "FROM lmeta ")),
}
ORACLES["revision_feed_in_batches"] = ORACLES["revision_feed"]
