"""The registered queries as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from spanloom.functions import outcome
from spanloom.functions.intent import INTENT_PATTERNS
from spanloom.functions.labels import (
    PATH_CONVENTIONS,
    OBJECTS,
    RUNNERS,
    TASK_ACTIONS,
    TOKEN_ACTIONS,
    WELL_KNOWN_PATHS,
)

# ---- Shared parts --------------------------------------------------------------------------------

EV = """ev AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    'e' || CAST(event_id AS VARCHAR) AS id, CAST(epoch_us(ts) * 1000 AS BIGINT) AS s,
    CAST(epoch_us(ts) * 1000 + CAST(round(value * 600) AS BIGINT) * 1000000000 AS BIGINT) AS e
  FROM events)"""


def pick(index: str, values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(({index}) % {len(values)} AS INT) + 1]"


def call_input(k: str) -> str:
    return f"""CASE WHEN ({k}) % 2 = 0
      THEN '{{"file_path":"/repo/packages/p' || CAST(({k}) % 3 AS VARCHAR) || '/src/f' || CAST(({k}) % 5 AS VARCHAR) || '.ts"}}'
      ELSE '{{"command":"' || {pick(k, ['git status', 'pnpm test', 'grep x y', 'ls'])} || '"}}' END"""


KINDS = ["not_found", "invalid_args", "permission", "timeout", "nonzero_exit"]
HOOKS = ["PreToolUse:Edit", "PreToolUse:Bash", "PostToolUse:Edit", "PostToolUse:Bash",
         "UserPromptSubmit", "Stop"]
RESULTS = ["no such file", "Permission denied", "timed out", "exit code 2", "done"]

NODES = f"""{EV},
typed AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN 'interaction' WHEN event_type = 'purchase' THEN 'hook'
    WHEN event_type = 'view' THEN 'llm_request' WHEN event_type = 'click' AND k % 9 = 0 THEN 'tool.execution'
    ELSE 'tool' END AS type FROM ev),
owned AS (
  SELECT * FROM (SELECT *, last_value(CASE WHEN type = 'interaction' THEN id END IGNORE NULLS) OVER (
      PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS interaction_id
    FROM typed) WHERE interaction_id IS NOT NULL),
placed AS (
  SELECT *, last_value(CASE WHEN type = 'tool' THEN id END IGNORE NULLS) OVER w AS last_tool,
    last_value(CASE WHEN type = 'tool.execution' THEN id END IGNORE NULLS) OVER w AS last_run
  FROM owned WINDOW w AS (PARTITION BY interaction_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
nodes AS (
  SELECT event_id, user_id, k, value, id, type, s, e, interaction_id,
    'session-' || CAST(user_id AS VARCHAR) AS session_id,
    CASE WHEN type = 'interaction' THEN NULL WHEN type = 'tool.execution' THEN coalesce(last_tool, interaction_id)
      WHEN type = 'llm_request' AND k % 13 = 0 THEN coalesce(last_run, interaction_id) ELSE interaction_id END AS parent,
    (e - s) / 1e6 AS duration_ms,
    CASE WHEN type = 'llm_request' THEN CASE WHEN k % 2 = 0 THEN 'repl_main_thread' ELSE 'side' END END AS source,
    CASE WHEN type = 'llm_request' THEN CASE WHEN k % 10 = 0 THEN 'small-haiku' ELSE 'big' END END AS model,
    CASE WHEN type = 'llm_request' THEN CAST(k AS DOUBLE) END AS tokens_in,
    CASE WHEN type = 'llm_request' THEN value END AS tokens_out,
    CASE WHEN type = 'llm_request' AND k % 4 = 0 THEN value / 100 END AS cost_usd,
    CASE WHEN type = 'tool' THEN {pick('k', ['Edit', 'Bash'])} WHEN type = 'hook' THEN {pick('k', HOOKS)} END AS name,
    CASE WHEN type = 'tool' AND k % 5 <> 0 THEN 'tu' || CAST(k % 3 AS VARCHAR) END AS tool_use_id,
    CASE WHEN type = 'tool' THEN {call_input('k')} END AS tool_input,
    CASE WHEN type = 'tool' THEN event_type = 'error' END AS is_error,
    CASE WHEN type = 'tool' AND event_type = 'error' THEN {pick('k', KINDS)} END AS error_kind,
    CASE WHEN type = 'tool.execution' THEN 1 ELSE 2 END AS rnk,
    row_number() OVER (PARTITION BY interaction_id ORDER BY s, id) - 1 AS seq
  FROM placed)"""

TOOL_SEM = """sem AS (
  SELECT id, CASE WHEN name = 'Edit' THEN 'edit source code'
      ELSE (['version control', 'run tests', 'search', 'run'])[CAST(k % 4 AS INT) + 1] END AS action,
    CASE WHEN name = 'Edit' THEN 'packages/p' || CAST(k % 3 AS VARCHAR) || '/src/f' || CAST(k % 5 AS VARCHAR) || '.ts' END AS repo_path,
    CASE WHEN name = 'Edit' THEN 'p' || CAST(k % 3 AS VARCHAR) END AS package
  FROM nodes WHERE type = 'tool')"""

METRICS = f"""{NODES}, {TOOL_SEM},
metrics AS (
  SELECT i.id AS interaction_id, i.session_id, CAST(i.k AS BIGINT) AS sequence,
    CAST(length('please fix item ' || CAST(i.k AS VARCHAR)) AS BIGINT) AS prompt_len,
    count(*) FILTER (WHERE n.type = 'tool') AS tool_count,
    count(*) FILTER (WHERE n.type = 'llm_request') AS llm_count,
    round(sum(n.tokens_in), 6) AS tokens_in, round(sum(n.tokens_out), 6) AS tokens_out,
    sum(CASE WHEN n.type = 'llm_request' THEN 0.0::DOUBLE END) AS cache_read_tokens,
    sum(CASE WHEN n.type = 'llm_request' THEN 0.0::DOUBLE END) AS cache_write_tokens,
    round(sum(n.cost_usd), 6) AS cost_usd, i.duration_ms,
    CASE WHEN count(*) FILTER (WHERE n.type = 'tool') > 0 THEN 'agentic' ELSE 'direct' END AS shape,
    count(DISTINCT sem.repo_path) AS distinct_files,
    count(*) FILTER (WHERE n.type = 'tool' AND n.is_error) AS error_count
  FROM nodes i JOIN nodes n ON n.interaction_id = i.id LEFT JOIN sem ON sem.id = n.id
  WHERE i.type = 'interaction' GROUP BY i.id, i.session_id, i.k, i.duration_ms)"""

MEMBERS = f"""{NODES},
direct AS (SELECT * FROM nodes WHERE parent = interaction_id AND type IN ('llm_request', 'tool', 'hook')),
seeds AS (SELECT *, source AS lane FROM direct WHERE type = 'llm_request'),
choice AS (
  SELECT o.id, d.lane, row_number() OVER (PARTITION BY o.id ORDER BY
      CASE WHEN d.s <= o.s AND o.s <= d.e THEN 0 WHEN d.e <= o.s THEN 1 ELSE 2 END,
      CASE WHEN d.s <= o.s AND o.s <= d.e THEN -d.s WHEN d.e <= o.s THEN -d.e ELSE d.s END, d.s, d.id) AS r
  FROM direct o JOIN seeds d ON d.parent = o.parent
  WHERE o.type <> 'llm_request' AND NOT (o.type = 'hook' AND o.name = 'UserPromptSubmit')),
lanes AS (
  SELECT id, lane FROM seeds UNION ALL SELECT id, lane FROM choice WHERE r = 1
  UNION ALL SELECT DISTINCT o.id, d.lane FROM direct o JOIN seeds d ON d.parent = o.parent
    WHERE o.type = 'hook' AND o.name = 'UserPromptSubmit' AND d.lane = 'repl_main_thread'),
members AS (
  SELECT n.*, n.parent AS owner, l.lane,
    row_number() OVER (PARTITION BY n.parent, l.lane ORDER BY n.s, n.rnk, n.id) - 1 AS position
  FROM lanes l JOIN nodes n ON n.id = l.id)"""

def result_message(n: str) -> str:
    return f"""'{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"tu' || CAST(({n}) % 3 AS VARCHAR)
    || '","is_error":' || CASE WHEN ({n}) % 5 <> 4 THEN 'true' ELSE 'false' END
    || ',"content":"' || {pick(n, RESULTS)} || '"}}]}}'"""


FRESH = f"""{MEMBERS},
sent AS (
  SELECT owner, lane, position, id, k, 0 AS idx, '{{"role":"user","content":"m' || CAST(k % 4 AS VARCHAR) || '"}}' AS message
  FROM members WHERE type = 'llm_request'
  UNION ALL SELECT owner, lane, position, id, k, 1, {result_message('k + 2')} FROM members WHERE type = 'llm_request'
  UNION ALL SELECT owner, lane, position, id, k, 2, {result_message('k + 3')} FROM members WHERE type = 'llm_request'),
fresh AS (
  SELECT * FROM (SELECT *, min(position) OVER (PARTITION BY owner, lane, message) AS first_position FROM sent)
  WHERE position = first_position)"""

EDGES = f"""{FRESH},
lane_first AS (SELECT owner, lane, s AS ls, rnk AS lr FROM members WHERE position = 0),
part AS (
  SELECT id, owner, lane, position, owner AS grp, TRUE AS is_top FROM members
  UNION ALL
  SELECT n.id, p.owner, p.lane, p.position, n.parent, FALSE FROM nodes n JOIN part p ON n.parent = p.id),
steps AS (
  SELECT p.owner, p.lane, p.position, p.grp, p.is_top, n.id, n.type, n.name, n.tool_use_id, n.s, n.e,
    lag(n.id) OVER (PARTITION BY p.owner, p.lane, p.grp ORDER BY n.s, n.rnk, n.id) AS sibling
  FROM part p JOIN nodes n ON n.id = p.id),
prevs AS (
  SELECT st.*, CASE WHEN is_top THEN sibling WHEN h.type = 'tool' THEN st.grp ELSE coalesce(sibling, st.grp) END AS prev
  FROM steps st LEFT JOIN nodes h ON h.id = st.grp),
emit AS (
  SELECT owner, use_id, id AS emitter FROM (
    SELECT m.owner, m.id, u.use_id, row_number() OVER (PARTITION BY m.owner, u.use_id
      ORDER BY l.ls DESC, l.lr DESC, m.lane DESC, m.position DESC) AS r
    FROM members m JOIN lane_first l ON l.owner = m.owner AND l.lane = m.lane,
      LATERAL (SELECT unnest(['tu' || CAST(m.k % 3 AS VARCHAR), 'tu' || CAST((m.k + 1) % 3 AS VARCHAR)]) AS use_id) u
    WHERE m.type = 'llm_request' AND m.k % 3 <> 0) WHERE r = 1),
tool_of AS (
  SELECT owner, tool_use_id, lane, id FROM (
    SELECT t.*, row_number() OVER (PARTITION BY t.owner, t.tool_use_id
      ORDER BY l.ls DESC, l.lr DESC, t.lane DESC, t.position DESC, t.s DESC, t.id DESC) AS r
    FROM steps t JOIN lane_first l ON l.owner = t.owner AND l.lane = t.lane
    WHERE t.type = 'tool' AND t.tool_use_id IS NOT NULL) WHERE r = 1),
hooked AS (
  SELECT h.id AS hook_id, h.position AS hook_at, t.id AS tool_id,
    row_number() OVER (PARTITION BY h.id ORDER BY t.position DESC) AS r
  FROM members h JOIN members t ON t.owner = h.owner AND t.lane = h.lane AND t.type = 'tool'
    AND h.name = 'PostToolUse:' || t.name AND t.position < h.position
  WHERE h.type = 'hook'),
post AS (
  SELECT tool_id, hook_id FROM (SELECT *, row_number() OVER (PARTITION BY tool_id ORDER BY hook_at DESC) AS q
    FROM hooked WHERE r = 1) WHERE q = 1),
fan_in AS (
  SELECT f.id AS to_id, coalesce(post.hook_id, t.id) AS from_id
  FROM fresh f JOIN tool_of t ON t.owner = f.owner AND t.lane = f.lane AND t.tool_use_id = 'tu' || CAST((f.k + f.idx + 1) % 3 AS VARCHAR)
  LEFT JOIN post ON post.tool_id = t.id WHERE f.idx > 0),
pairs AS (
  SELECT p.id AS to_id, CASE WHEN q.type = 'hook' AND q.name = 'PreToolUse:' || p.name THEN p.prev
      ELSE coalesce(emit.emitter, p.prev) END AS from_id, p.grp
  FROM prevs p LEFT JOIN nodes q ON q.id = p.prev LEFT JOIN emit ON emit.owner = p.owner AND emit.use_id = p.tool_use_id
  WHERE p.type = 'tool'
  UNION ALL SELECT id, prev, grp FROM prevs WHERE type <> 'tool' AND NOT (type = 'llm_request' AND id IN (SELECT to_id FROM fan_in))
  UNION ALL SELECT to_id, from_id, NULL FROM fan_in),
edges AS (
  SELECT p.from_id, p.to_id, nullif((b.s - CASE WHEN p.grp = p.from_id THEN a.s ELSE a.e END) / 1e6, 0) AS gap_ms
  FROM pairs p JOIN nodes a ON a.id = p.from_id JOIN nodes b ON b.id = p.to_id)"""

MAIN = """main_lane AS (
  SELECT owner, lane FROM (SELECT owner, lane, row_number() OVER (PARTITION BY owner
      ORDER BY CASE WHEN lane = 'repl_main_thread' THEN 0 ELSE 1 END, s, rnk, lane) AS r
    FROM members WHERE position = 0) WHERE r = 1),
main_members AS (SELECT m.* FROM members m JOIN main_lane l ON l.owner = m.owner AND l.lane = m.lane)"""

WITH, REC = "WITH ", "WITH RECURSIVE "

LOGS = f"""{EV},
logs AS (
  SELECT CAST(user_id AS VARCHAR) AS harness_session, event_id AS pos, s + 60000000000 AS at, event_id + k % 3 AS span_number,
    {pick('k', ['api_request', 'api_request_body', 'api_response_body', 'hook_execution_start', 'hook_execution_complete', 'tool_decision'])} AS event_name,
    CASE WHEN k % 7 <> 0 THEN 'h' || CAST(k % 5 AS VARCHAR) END AS hook_name,
    CASE WHEN k % 4 = 0 THEN 'q' || CAST(k AS VARCHAR) END AS request_id,
    CASE WHEN k % 11 <> 0 THEN 'b' || CAST(event_id AS VARCHAR) END AS body, CAST(value AS VARCHAR) AS cost_usd
  FROM ev)"""


def hex_id(number: str) -> str:
    return f"'s' || lower(lpad(printf('%X', {number}), 16, '0'))"


SPAN_TYPES = """CASE event_type WHEN 'signup' THEN 'interaction' WHEN 'view' THEN 'llm_request' WHEN 'error' THEN 'tool'
    WHEN 'click' THEN 'tool.execution' ELSE 'tool.blocked_on_user' END"""

SPANS = f"""{LOGS},
spans AS (
  SELECT CAST(user_id AS VARCHAR) AS harness_session, event_id, k, s, value, event_type,
    CASE WHEN k = 50 THEN 's000000' ELSE {hex_id('event_id')} END AS id,
    CASE WHEN event_type <> 'signup' AND k % 7 <> 0 THEN {hex_id('event_id - 1')} END AS parent,
    CASE WHEN k = 51 THEN s - 1 WHEN k = 52 THEN NULL ELSE e END AS e, {SPAN_TYPES} AS span_type,
    CASE WHEN event_type = 'view' AND k % 3 = 0 THEN 'q' || CAST(k AS VARCHAR) END AS request_id,
    '/t/' || CAST(user_id AS VARCHAR) || '/trace-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.json' AS path
  FROM ev)"""

ATTRIBUTED = f"""{SPANS},
by_request AS (
  SELECT l.harness_session, l.pos, t.id AS span_id FROM logs l JOIN (
    SELECT harness_session, request_id, id, row_number() OVER (PARTITION BY harness_session, request_id
      ORDER BY s DESC, event_id DESC) AS r FROM spans WHERE request_id IS NOT NULL) t
    ON t.harness_session = l.harness_session AND t.request_id = l.request_id AND t.r = 1),
kids AS (SELECT DISTINCT harness_session, id FROM spans WHERE parent IS NOT NULL),
rest AS (SELECT *, {hex_id('span_number')} AS own FROM logs WHERE request_id IS NULL),
by_span AS (SELECT r.harness_session, r.pos, r.own AS span_id FROM rest r JOIN kids c ON c.harness_session = r.harness_session AND c.id = r.own),
by_time AS (
  SELECT harness_session, pos, span_id FROM (
    SELECT r.harness_session, r.pos, p.id AS span_id, row_number() OVER (PARTITION BY r.harness_session, r.pos
      ORDER BY p.e - p.s, p.s, p.event_id) AS q
    FROM rest r JOIN spans p ON p.harness_session = r.harness_session AND p.s <= r.at AND r.at <= p.e
    WHERE NOT EXISTS (SELECT 1 FROM kids c WHERE c.harness_session = r.harness_session AND c.id = r.own)) WHERE q = 1),
links AS (SELECT * FROM by_request UNION ALL SELECT * FROM by_span UNION ALL SELECT * FROM by_time)"""


def quoted(raw: str) -> str:
    return "'" + raw.replace("'", "''") + "'"


def intent_case(column: str) -> str:
    cases = [
        f"WHEN regexp_matches(t, {quoted(p.replace('[?]', '?'))}, 'i') THEN '{c}'"
        for c, p in INTENT_PATTERNS
    ]
    return f"CASE WHEN t = '' THEN 'other' {' '.join(cases)} ELSE 'other' END".replace(
        " t ", f" {column} "
    ).replace("(t,", f"({column},")


SPACE_CLASS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def rtrim(column: str) -> str:
    return f"regexp_replace({column}, '{SPACE_CLASS}$', '')"


def trim(column: str) -> str:
    return rtrim(f"regexp_replace({column}, '^{SPACE_CLASS}', '')")


TALK = f"""talk AS (
  SELECT *, 1700000000 + conv_id * 1000 + turn * 10 AS sec, role = 'user' AND NOT starts_with(text, '<') AS is_prompt FROM conversations),
turns AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS sequence FROM talk WHERE is_prompt),
held AS (
  SELECT t.*, last_value(CASE WHEN is_prompt THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt_turn,
    last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_turn FROM talk t)"""

# Every fourth user entry is no prompt here.
TOOL_TALK = TALK.replace("NOT starts_with(text, '<')", "NOT starts_with(text, '<') AND turn % 4 <> 2")

SPACES = r"[ \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$"


def any_of(cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, {quoted(c)})" for c in cues) + ")"


ERROR_CASE = f"""CASE WHEN {any_of(outcome.FAILED_MATCH)} THEN 'invalid_args' WHEN {any_of(outcome.NOT_FOUND)} THEN 'not_found'
    WHEN {any_of(outcome.PERMISSION)} THEN 'permission' WHEN {any_of(outcome.TIMEOUT)} THEN 'timeout'
    WHEN {any_of(outcome.INVALID_ARGS)} THEN 'invalid_args'
    WHEN regexp_matches(low, 'exit code\\s+[1-9]') OR {any_of(outcome.NONZERO_EXIT)} THEN 'nonzero_exit' ELSE 'other' END"""

COMMANDS = ["git commit -m x", "cd pkg && pnpm run test", "npm install", "rg foo", "ls -la", "cd /tmp; make all",
            "yarn exec eslint", "", "pytest tests", "pnpm", "cd a;b;grep x", "docker ps", "npx tsc"]
ROOTS = ["/repo/", "/repo/.claude/worktrees/w1/", "/home/me/worktrees/x/", "/home/me/", "", "/home/me/.claude/"]
FILES = ["src/a.ts", "packages/core/x.test.ts", "README.md", "package.json", ".env.local", "apps/site/main.e2e.test.tsx",
         ".github/workflows/ci.yml", "settings.json", "libs/u/tsconfig.base.json", "data.bin", "pnpm-lock.yaml"]
PATHS = f"""paths AS (
  SELECT l_orderkey, l_linenumber, {pick('l_orderkey', ROOTS)} || {pick('l_orderkey + l_linenumber', FILES)} AS path,
    CASE WHEN l_orderkey % 4 <> 0 THEN '/repo' END AS cwd FROM lineitem),
bare AS (
  SELECT *, CASE WHEN contains(path, '.claude/worktrees/') THEN regexp_extract(path, '\\.claude/worktrees/[^/]*/?(.*)$', 1)
    WHEN contains(path, 'worktrees/') THEN regexp_extract(path, 'worktrees/[^/]*/?(.*)$', 1) ELSE path END AS bare FROM paths)"""
OBJECT = dict(OBJECTS)
PATH_CASE = " ".join(
    [f"WHEN regexp_matches(bare, {quoted(p)}) THEN {quoted(label)}" for p, label in WELL_KNOWN_PATHS]
    + [f"WHEN regexp_matches(bare, {quoted(p)}, 'i') THEN {quoted(OBJECT[o])}" for p, o in PATH_CONVENTIONS]
)


def words(values: list[str]) -> str:
    return ", ".join(quoted(v) for v in values)


ACTION_CASE = (
    f"CASE WHEN head IN ({words(RUNNERS)}) THEN CASE "
    + " ".join(f"WHEN task IN ({words(w)}) THEN '{a}'" for w, a in TASK_ACTIONS)
    + " ELSE 'run' END "
    + " ".join(f"WHEN head IN ({words(w)}) THEN '{a}'" for w, a in TOKEN_ACTIONS)
    + " ELSE 'run' END"
)

RECOVERY = """spent AS (SELECT *, coalesce(sum(tokens_out) OVER (PARTITION BY interaction_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS spent FROM nodes),
calls AS (SELECT s.*, sem.repo_path FROM spent s JOIN sem ON sem.id = s.id)"""


def recovery(extra: str = "", keep: str = "") -> str:
    return f"""SELECT f.interaction_id, f.name{keep}, f.id AS failed_id, f.error_kind, g.id AS recovered_id,
      CAST(g.seq - f.seq AS BIGINT) AS steps, round(g.spent - f.spent, 6) AS tokens_between, (g.s - f.e) / 1e6 AS ms_between
    FROM calls f LEFT JOIN calls g ON g.interaction_id = f.interaction_id AND g.name = f.name{extra} AND NOT g.is_error AND g.seq =
      (SELECT min(h.seq) FROM calls h WHERE h.interaction_id = f.interaction_id AND h.name = f.name{extra.replace('g.', 'h.')}
        AND NOT h.is_error AND h.seq > f.seq)
    WHERE f.is_error"""


ANCESTRY = """up AS (
  SELECT id AS seed, parent AS id, 1 AS depth FROM nodes WHERE parent IS NOT NULL
  UNION ALL SELECT u.seed, n.parent, u.depth + 1 FROM up u JOIN nodes n ON n.id = u.id WHERE n.parent IS NOT NULL)"""

# ---- Queries -------------------------------------------------------------------------------------

SQL = {
    "session_rollup": f"""WITH {NODES} SELECT session_id, round(sum(cost_usd), 6) AS cost_usd, round(sum(tokens_in), 6) AS tokens_in,
      round(sum(tokens_out), 6) AS tokens_out, count(*) FILTER (WHERE type = 'llm_request') AS llm_calls,
      count(*) FILTER (WHERE type = 'tool') AS tool_calls FROM nodes GROUP BY session_id""",
    "interaction_metrics": f"WITH {METRICS} SELECT * FROM metrics",
    "interaction_rollup": f"""WITH {METRICS} SELECT interaction_id, shape, tool_count, llm_count, tokens_in, tokens_out, cost_usd,
      duration_ms, distinct_files, error_count FROM metrics""",
    "shape_counts": f"WITH {METRICS} SELECT shape, count(*) AS interactions FROM metrics GROUP BY shape",
    "load_summary": f"""WITH {NODES} SELECT count(DISTINCT session_id) AS sessions,
      count(*) FILTER (WHERE type = 'interaction') AS interactions, count(*) AS nodes FROM nodes""",
    "typed_views": f"""WITH {NODES} SELECT CASE type WHEN 'llm_request' THEN 'llm_requests' WHEN 'tool' THEN 'tools'
      ELSE 'interactions' END AS relation, id, session_id, seq, duration_ms FROM nodes WHERE type IN ('llm_request', 'tool', 'interaction')""",
    "interaction_windows": f"""WITH {EV} SELECT user_id, event_id, row_number() OVER w - 1 AS sequence, s, lead(s) OVER w AS next_s
      FROM ev WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)""",
    "node_seq": f"WITH {NODES} SELECT interaction_id, id, seq FROM nodes",
    "narrowest_span": f"""WITH {EV} SELECT id, span_id FROM (SELECT p.id, i.id AS span_id, row_number() OVER (PARTITION BY p.id
      ORDER BY i.e - i.s, i.s, i.id) AS r FROM ev p JOIN ev i ON i.user_id = p.user_id AND i.s <= p.s AND p.s <= i.e
      WHERE p.event_type IN ('error', 'click') AND i.event_type IN ('view', 'purchase')) WHERE r = 1""",
    "last_ended_before": f"""WITH {EV} SELECT id, span_id FROM (SELECT p.id, i.id AS span_id, row_number() OVER (PARTITION BY p.id
      ORDER BY i.e DESC, i.id) AS r FROM ev p JOIN ev i ON i.user_id = p.user_id AND i.e <= p.s
      WHERE p.event_type IN ('error', 'click') AND i.event_type IN ('view', 'purchase')) WHERE r = 1""",
    "positional_zip": f"""WITH {LOGS},
      a AS (SELECT harness_session, body, row_number() OVER (PARTITION BY harness_session ORDER BY pos) AS r FROM logs
        WHERE event_name = 'api_request_body' AND body IS NOT NULL),
      b AS (SELECT harness_session, request_id, row_number() OVER (PARTITION BY harness_session ORDER BY pos) AS r FROM logs
        WHERE event_name = 'api_response_body' AND request_id IS NOT NULL)
      SELECT a.harness_session, b.request_id, arg_max(a.body, a.r) AS zipped_body FROM a JOIN b USING (harness_session, r)
      GROUP BY a.harness_session, b.request_id""",
    "hook_hints": f"""WITH {EV},
      hooks AS (SELECT *, {pick('k', ['PreToolUse:Edit', 'PostToolUse:Edit', 'PreToolUse:Bash', 'PostToolUse:Bash', 'Stop', 'Notification',
          'PreToolUse:', 'Other:Edit', 'SessionStart', 'UserPromptSubmit'])} AS hook FROM ev WHERE event_type = 'click'),
      spans AS (SELECT *, CASE WHEN event_type = 'error' THEN {pick('k', ['Edit', 'Bash'])} END AS tool FROM ev WHERE event_type <> 'click'),
      pre AS (SELECT h.user_id, h.id, t.id AS hint, row_number() OVER (PARTITION BY h.id ORDER BY t.s, t.id) AS r
        FROM hooks h JOIN spans t ON t.user_id = h.user_id AND h.hook = 'PreToolUse:' || t.tool AND t.s >= h.s),
      post AS (SELECT h.user_id, h.id, t.id AS hint, row_number() OVER (PARTITION BY h.id ORDER BY t.e DESC, t.id) AS r
        FROM hooks h JOIN spans t ON t.user_id = h.user_id AND h.hook = 'PostToolUse:' || t.tool AND t.e <= h.s),
      turn AS (SELECT h.user_id, h.id, t.id AS hint, row_number() OVER (PARTITION BY h.id ORDER BY t.s, t.event_id) AS r
        FROM hooks h JOIN spans t ON t.user_id = h.user_id AND t.event_type = 'signup'
        WHERE h.hook IN ('Stop', 'UserPromptSubmit')),
      loose AS (SELECT h.user_id, h.id, t.id AS hint, row_number() OVER (PARTITION BY h.id ORDER BY t.e <= h.s DESC,
          CASE WHEN t.e <= h.s THEN t.e END DESC, CASE WHEN t.e > h.s THEN t.e - t.s END, t.s, t.event_id) AS r
        FROM hooks h JOIN spans t ON t.user_id = h.user_id AND (t.e <= h.s OR t.s <= h.s) WHERE h.hook IN ('Notification', 'SessionStart', 'PreToolUse:'))
      SELECT CAST(user_id AS VARCHAR) AS harness_session, id, hint FROM (FROM pre UNION ALL FROM post UNION ALL FROM turn UNION ALL FROM loose)
      WHERE r = 1""",
    "log_records": """SELECT '/t/' || CAST(user_id AS VARCHAR) || '/logs.json' AS path, event_id, event_type AS event_name,
      '{"[\\' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) || '"} é ]"' AS body,
      lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous
      FROM events WHERE user_id IS NOT NULL""",
    "hook_pairs": f"""WITH {LOGS},
      a AS (SELECT *, row_number() OVER (PARTITION BY harness_session, hook_name ORDER BY pos) AS r FROM logs
        WHERE event_name = 'hook_execution_start' AND hook_name IS NOT NULL),
      b AS (SELECT *, row_number() OVER (PARTITION BY harness_session, hook_name ORDER BY pos) AS r FROM logs
        WHERE event_name = 'hook_execution_complete' AND hook_name IS NOT NULL)
      SELECT a.harness_session, a.hook_name, a.at AS start_ns, coalesce(b.at, a.at) AS end_ns
      FROM a LEFT JOIN b ON b.harness_session = a.harness_session AND b.hook_name = a.hook_name AND b.r = a.r""",
    "otel_spans": f"""WITH {SPANS} SELECT harness_session, id, parent, s AS start_ns, e AS end_ns, span_type,
      CASE WHEN event_type = 'view' THEN 'big' END AS model, CASE WHEN event_type = 'view' THEN k END AS tokens_in,
      CASE WHEN event_type = 'view' AND k % 17 <> 0 THEN k END AS tokens_out, request_id,
      CASE WHEN event_type = 'error' THEN {pick('k', ['Edit', 'Bash'])} END AS tool_name,
      CASE WHEN event_type = 'signup' THEN 'prompt ' || CAST(k AS VARCHAR) END AS prompt,
      CASE WHEN event_type = 'signup' THEN 'someone' END AS user_id, CASE WHEN event_type = 'signup' THEN k END AS sequence,
      CASE WHEN event_type = 'view' AND k % 4 = 0 THEN value END AS cost_usd FROM spans""",
    "otel_rejects": f"""WITH {SPANS} SELECT harness_session, id, span_type AS type, 'tokens_out' AS missing FROM spans
      WHERE event_type = 'view' AND k % 17 = 0""",
    "span_violations": f"""WITH {SPANS},
      b AS (SELECT *, '/t/' || harness_session AS dir, CASE WHEN k = 50 THEN 'AAAA' ELSE to_base64(unhex(substr(id, 2))) END AS b64,
        CASE WHEN parent IS NOT NULL THEN to_base64(unhex(substr(parent, 2))) END AS p64 FROM spans)
      SELECT dir AS path, b64 AS span_id, 'span_id_size' AS rule FROM b WHERE k = 50
      UNION ALL SELECT dir, b64, 'empty_name' FROM b WHERE k = 53
      UNION ALL SELECT dir, b64, 'end_not_digits' FROM b WHERE k = 52
      UNION ALL SELECT dir, b64, 'ends_before_start' FROM b WHERE k = 51
      UNION ALL SELECT dir, b64, 'duplicate_span_id' FROM b GROUP BY dir, b64 HAVING count(*) > 1
      UNION ALL SELECT dir, b64, 'unknown_parent' FROM b WHERE p64 IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM b c WHERE c.dir = b.dir AND c.b64 = b.p64)""",
    "log_attribution": f"WITH {ATTRIBUTED} SELECT harness_session, pos, span_id FROM links",
    "llm_enrichment": f"""WITH {ATTRIBUTED},
      j AS (SELECT l.*, k.span_id FROM logs l JOIN links k ON k.harness_session = l.harness_session AND k.pos = l.pos)
      SELECT harness_session, span_id AS id, arg_min(cost_usd, pos) FILTER (WHERE event_name = 'api_request') AS cost_usd,
        arg_min(body, pos) FILTER (WHERE event_name = 'api_request_body' AND body IS NOT NULL) AS log_request,
        arg_min(body, pos) FILTER (WHERE event_name = 'api_response_body' AND body IS NOT NULL) AS log_response
      FROM j GROUP BY harness_session, span_id""",
    "thread_assignment": f"WITH {MEMBERS} SELECT owner, id, lane FROM members WHERE type <> 'llm_request'",
    "threads": f"""WITH {MEMBERS} SELECT 'thread_' || lane AS thread_id, owner AS interaction_id, lane AS source, id AS node_id,
      position FROM members""",
    "first_seen_delta": f"WITH {FRESH} SELECT id, CAST(idx AS BIGINT) AS message_index, message FROM fresh",
    "message_deltas": f"""WITH {FRESH}, d AS (SELECT id, string_agg(message, ',' ORDER BY idx) AS m FROM fresh GROUP BY id)
      SELECT n.id, '[' || coalesce(d.m, '') || ']' AS request_messages_delta,
        CASE WHEN n.k % 3 = 0 THEN '[{{"type":"text","text":"All done."}}]' ELSE '['
          || '{{"type":"tool_use","id":"tu' || CAST(k % 3 AS VARCHAR) || '","name":"' || {pick('k', ['Edit', 'Bash'])} || '","input":' || {call_input('k')} || '}},'
          || '{{"type":"tool_use","id":"tu' || CAST((k + 1) % 3 AS VARCHAR) || '","name":"' || {pick('k + 1', ['Edit', 'Bash'])} || '","input":' || {call_input('k + 1')} || '}}]'
        END AS response_messages_delta
      FROM members n LEFT JOIN d ON d.id = n.id WHERE n.type = 'llm_request'""",
    "causal_edges": f"WITH RECURSIVE {EDGES} SELECT from_id, to_id, gap_ms FROM edges",
    "edge_gaps": f"""WITH RECURSIVE {EDGES} SELECT x.from_id, x.to_id, coalesce(x.gap_ms, nullif((b.s - a.e) / 1e6, 0)) AS gap_ms
      FROM edges x JOIN nodes a ON a.id = x.from_id JOIN nodes b ON b.id = x.to_id""",
    "prompt_edges": f"WITH {MEMBERS} SELECT owner AS from_id, id AS to_id, lane AS source FROM members WHERE position = 0 AND CAST(substr(owner, 2) AS BIGINT) % 7 <> 0",
    "main_thread_longest": f"""WITH {MEMBERS}, {MAIN} SELECT m.owner AS interaction_id, m.id, m.duration_ms,
      CASE WHEN i.duration_ms > 0 THEN least(1.0, m.duration_ms / i.duration_ms) END AS share_of_run
      FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY duration_ms DESC, position) AS r FROM main_members WHERE duration_ms > 0) m
      JOIN nodes i ON i.id = m.owner WHERE m.r = 1""",
    "parallel_levels": f"""WITH RECURSIVE {EDGES}, {MAIN}, d AS (SELECT DISTINCT from_id, to_id FROM edges)
      SELECT b.owner AS interaction_id, a.from_id AS fork_id, c.to_id AS join_id, count(*) AS branches,
        arg_min(b.id, (-b.duration_ms, b.id)) AS critical_id, max(b.duration_ms) AS critical_ms
      FROM main_members b JOIN d a ON a.to_id = b.id JOIN d c ON c.from_id = b.id
      WHERE b.type = 'tool' AND a.from_id IN (SELECT id FROM main_members) AND c.to_id IN (SELECT id FROM main_members)
      GROUP BY b.owner, a.from_id, c.to_id HAVING count(*) >= 2""",
    "hidden_subcalls": f"""WITH RECURSIVE {NODES},
      down AS (SELECT id AS tool_id, id, 0 AS depth, CAST([] AS VARCHAR[]) AS trail FROM (SELECT id FROM nodes WHERE type = 'tool')
        UNION ALL SELECT d.tool_id, n.id, d.depth + 1, list_append(d.trail, printf('%020d', n.s) || n.rnk || n.id)
          FROM down d JOIN nodes n ON n.parent = d.id)
      SELECT tool_id, subcall_id, model, duration_ms FROM (
        SELECT d.tool_id, n.id AS subcall_id, n.model, n.duration_ms, row_number() OVER (PARTITION BY d.tool_id ORDER BY d.trail) AS r
        FROM down d JOIN nodes n ON n.id = d.id WHERE d.depth > 0 AND n.type = 'llm_request' AND n.model LIKE '%haiku%') WHERE r = 1""",
    "tools_with_causes": f"""WITH RECURSIVE {EDGES} SELECT x.from_id AS inference_id, t.id AS tool_id, t.name, t.duration_ms
      FROM edges x JOIN nodes t ON t.id = x.to_id AND t.type = 'tool' JOIN nodes f ON f.id = x.from_id AND f.type = 'llm_request'""",
    "causal_reach": f"""WITH RECURSIVE {EDGES},
      last AS (SELECT arg_max(id, (s, id)) AS seed FROM nodes GROUP BY interaction_id),
      walk AS (SELECT l.seed, x.from_id AS node FROM last l JOIN edges x ON x.to_id = l.seed
        UNION SELECT w.seed, x.from_id FROM walk w JOIN edges x ON x.to_id = w.node)
      SELECT seed, node FROM walk""",
    "root_closure": f"WITH {NODES} SELECT id, interaction_id FROM nodes",
    "subtree": f"WITH RECURSIVE {NODES}, {ANCESTRY} SELECT id AS root, seed AS id, CAST(depth AS BIGINT) AS depth FROM up",
    "ancestor_path": f"""WITH RECURSIVE {NODES}, {ANCESTRY},
      top AS (SELECT n.id, n.session_id, coalesce(max(u.depth), 0) AS top FROM nodes n LEFT JOIN up u ON u.seed = n.id GROUP BY n.id, n.session_id),
      agent AS (SELECT 'agent-' || CAST(arg_min(user_id, (session_id, s, id)) AS VARCHAR) AS agent_id FROM nodes WHERE type = 'interaction')
      SELECT id, CAST(0 AS BIGINT) AS level, 'node' AS kind, id AS step_id FROM nodes
      UNION ALL SELECT seed, depth, 'node', id FROM up
      UNION ALL SELECT id, top + 1, 'session', session_id FROM top
      UNION ALL SELECT id, top + 2, 'agent', agent_id FROM top, agent""",
    "nearest_tool": f"""WITH RECURSIVE {NODES}, {ANCESTRY} SELECT seed AS id, id AS tool_id FROM (
      SELECT u.seed, u.id, row_number() OVER (PARTITION BY u.seed ORDER BY u.depth) AS r FROM up u JOIN nodes n ON n.id = u.id
      WHERE n.type = 'tool') WHERE r = 1""",
    "containment": f"WITH {NODES} SELECT parent AS parent_id, id AS child_id FROM nodes WHERE parent IS NOT NULL",
    "session_dimension": f"""WITH {NODES},
      agent AS (SELECT 'agent-' || CAST(arg_min(user_id, (session_id, s, id)) AS VARCHAR) AS agent_id FROM nodes WHERE type = 'interaction')
      SELECT DISTINCT session_id AS id, agent_id, CAST(user_id AS VARCHAR) AS user_id, CAST(user_id AS VARCHAR) AS session_id,
        '/repo' AS cwd, CAST(NULL AS VARCHAR) AS branch FROM nodes, agent WHERE type = 'interaction'""",
    "agent_dimension": f"""WITH {NODES} SELECT 'agent-' || u AS id, u AS user_id FROM (
      SELECT CAST(arg_min(user_id, (session_id, s, id)) AS VARCHAR) AS u FROM nodes WHERE type = 'interaction')""",
    "dedupe_nodes": f"WITH {NODES} SELECT id, session_id, tokens_out FROM nodes",
    "tool_outcomes": f"""WITH {NODES},
      r0 AS (SELECT session_id, s, id, k + 2 AS k, 1 AS idx FROM nodes WHERE type = 'llm_request'
        UNION ALL SELECT session_id, s, id, k + 3, 2 FROM nodes WHERE type = 'llm_request'),
      res AS (SELECT session_id, 'tu' || CAST(k % 3 AS VARCHAR) AS use_id, arg_max(k, (s, id, idx)) AS k FROM r0
        GROUP BY session_id, 'tu' || CAST(k % 3 AS VARCHAR))
      SELECT t.id, CASE WHEN r.k IS NULL THEN NULL ELSE r.k % 5 <> 4 END AS is_error,
        CASE WHEN r.k % 5 <> 4 THEN (['not_found', 'permission', 'timeout', 'nonzero_exit'])[CAST(r.k % 5 AS INT) + 1] END AS error_kind,
        CAST(length({pick('r.k', RESULTS)}) AS BIGINT) AS output_size,
        CASE WHEN r.k % 5 <> 4 THEN {pick('r.k', RESULTS)} END AS error_message
      FROM nodes t JOIN res r ON r.session_id = t.session_id AND r.use_id = t.tool_use_id WHERE t.type = 'tool' AND t.tool_use_id IS NOT NULL
      UNION ALL
      SELECT t.id, NULL, NULL, NULL, NULL FROM nodes t WHERE t.type = 'tool' AND t.tool_use_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM res r WHERE r.session_id = t.session_id AND r.use_id = t.tool_use_id)
      UNION ALL
      SELECT t.id, t.is_error, t.error_kind, NULL, CASE WHEN t.is_error THEN 'bad ' || CAST(t.k AS VARCHAR) END FROM nodes t
        WHERE t.type = 'tool' AND t.tool_use_id IS NULL""",
    "tool_semantics": f"""WITH {NODES}, {TOOL_SEM} SELECT id, CAST(0 AS BIGINT) AS sequence_in_node, action, repo_path, package,
      CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS comment FROM sem""",
    "inference_semantics": f"""WITH {MEMBERS},
      calls AS (SELECT id, CAST(u.n AS BIGINT) AS n, k + u.n AS c FROM members, LATERAL (SELECT unnest([0, 1]) AS n) u
        WHERE type = 'llm_request' AND k % 3 <> 0)
      SELECT id, n AS sequence_in_node, CASE WHEN c % 2 = 0 THEN 'invoke edit source code'
          ELSE (['invoke version control', 'invoke run tests', 'invoke search', 'invoke run'])[CAST(c % 4 AS INT) + 1] END AS action,
        CASE WHEN c % 2 = 0 THEN 'packages/p' || CAST(c % 3 AS VARCHAR) || '/src/f' || CAST(c % 5 AS VARCHAR) || '.ts' END AS repo_path,
        CASE WHEN c % 2 = 0 THEN 'p' || CAST(c % 3 AS VARCHAR) END AS package,
        CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS comment FROM calls
      UNION ALL SELECT id, 0, 'respond', NULL, NULL, NULL, NULL FROM members WHERE type = 'llm_request' AND k % 3 = 0
      UNION ALL SELECT id, 0, model, NULL, NULL, NULL, NULL FROM nodes WHERE type = 'llm_request' AND id NOT IN (SELECT id FROM members)""",
    "node_context": f"""WITH {NODES}, {TOOL_SEM} SELECT id, package, repo_path, CAST(NULL AS VARCHAR) AS url FROM sem
      WHERE repo_path IS NOT NULL""",
    "resolve_node": f"""WITH {FRESH}, {TOOL_SEM}, d AS (SELECT id, string_agg(message, ',' ORDER BY idx) AS m FROM fresh GROUP BY id)
      SELECT n.id, n.type, n.seq, CASE WHEN m.id IS NOT NULL THEN '[' || coalesce(d.m, '') || ']' END AS request_messages_delta,
        CASE WHEN n.type = 'tool' THEN CAST(1 AS BIGINT) END AS entry_count, sem.action AS first_action
      FROM nodes n LEFT JOIN (SELECT id FROM members WHERE type = 'llm_request') m ON m.id = n.id LEFT JOIN d ON d.id = n.id
      LEFT JOIN sem ON sem.id = n.id""",
    "redundant_calls": f"""WITH {NODES} SELECT interaction_id, name, tool_input, count(*) AS occurrences,
      round(sum(duration_ms) - max(duration_ms), 6) AS approx_wasted_ms FROM nodes WHERE type = 'tool'
      GROUP BY interaction_id, name, tool_input HAVING count(*) >= 2""",
    "redundant_call_members": f"""WITH {NODES} SELECT interaction_id, name, tool_input, id FROM (SELECT *, count(*) OVER (
      PARTITION BY interaction_id, name, tool_input) AS c FROM nodes WHERE type = 'tool') WHERE c >= 2""",
    "longest_steps": f"""WITH {NODES} SELECT interaction_id, id, type, name, duration_ms FROM (SELECT *, row_number() OVER (
      PARTITION BY interaction_id ORDER BY duration_ms DESC, id) AS r FROM nodes) WHERE r = 1""",
    "misleading_files": f"""WITH {NODES}, {TOOL_SEM} SELECT sem.repo_path, count(*) AS failed_edits FROM nodes n JOIN sem ON sem.id = n.id
      WHERE n.is_error AND n.name = 'Edit' GROUP BY sem.repo_path""",
    "failed_edit_members": f"""WITH {NODES}, {TOOL_SEM} SELECT sem.repo_path, n.id FROM nodes n JOIN sem ON sem.id = n.id
      WHERE n.is_error AND n.name = 'Edit'""",
    "error_breakdown": f"""WITH {NODES}, {TOOL_SEM} SELECT n.error_kind, sem.action, count(*) AS errors FROM nodes n JOIN sem ON sem.id = n.id
      WHERE n.is_error GROUP BY n.error_kind, sem.action""",
    "verify_loop_excluded": f"""WITH {NODES}, {TOOL_SEM} SELECT n.error_kind, sem.action, count(*) AS errors FROM nodes n JOIN sem ON sem.id = n.id
      WHERE n.is_error AND NOT (n.name = 'Bash' AND n.error_kind = 'nonzero_exit' AND sem.action IN ('run tests', 'verify', 'lint', 'typecheck', 'search'))
      GROUP BY n.error_kind, sem.action""",
    "recovery_window": f"WITH {NODES}, {TOOL_SEM}, {RECOVERY} {recovery()}",
    "recovery_same_file": f"""WITH {NODES}, {TOOL_SEM}, {RECOVERY}
      {recovery(' AND g.repo_path = f.repo_path', ', f.repo_path')} AND f.repo_path IS NOT NULL""",
    "preventable_cost": f"""WITH {NODES}, {TOOL_SEM}, {RECOVERY}, w AS ({recovery()})
      SELECT name, error_kind, count(*) AS errors, count(recovered_id) AS recovered,
        round(sum(coalesce(tokens_between, 0)), 6) AS recovery_tokens, CAST(sum(coalesce(CAST(round(ms_between * 1e6) AS BIGINT), 0)) AS DOUBLE) / 1e6 AS recovery_ms
      FROM w GROUP BY name, error_kind""",
    "failure_facts": f"""WITH {NODES} SELECT id, error_kind AS kind, 'bad ' || CAST(k AS VARCHAR) AS message FROM nodes WHERE is_error""",
    "json_escape_hatch": f"""WITH {NODES} SELECT id, CASE WHEN k % 3 = 0 THEN 'end_turn' ELSE 'tool_use' END AS stop_reason FROM nodes
      WHERE type = 'llm_request'""",
    "chat_log_nodes": f"""WITH {TALK}
      SELECT 'interaction' AS type, 'session-c' || CAST(t.conv_id AS VARCHAR) AS session_id, t.sec * 1000000000 AS start_time_ns,
        coalesce((SELECT max(h.sec) FROM held h WHERE h.conv_id = t.conv_id AND h.prompt_turn = t.turn AND h.role = 'assistant'), t.sec) * 1000000000 AS end_time_ns,
        CAST(NULL AS DOUBLE) AS tokens_in, CAST(NULL AS DOUBLE) AS tokens_out, t.sequence, t.text AS prompt, '/repo' AS cwd,
        CAST(NULL AS VARCHAR) AS stop_reason, CAST(NULL AS BIGINT) AS reply_blocks FROM turns t
      UNION ALL
      SELECT 'llm_request', 'session-c' || CAST(h.conv_id AS VARCHAR),
        coalesce(1700000000 + h.conv_id * 1000 + h.user_turn * 10, h.sec) * 1000000000, h.sec * 1000000000,
        CAST(length(h.text) AS DOUBLE), CAST(h.turn AS DOUBLE), NULL, NULL, NULL, 'end_turn', 1
      FROM held h WHERE h.role = 'assistant' AND h.prompt_turn IS NOT NULL""",
    "chat_tool_nodes": f"""WITH {TOOL_TALK},
      replies AS (SELECT *, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS key, (conv_id + turn) % 3 <> 0 AS answered
        FROM held WHERE role = 'assistant' AND prompt_turn IS NOT NULL),
      fed AS (SELECT *, lag(CASE WHEN answered THEN 'u' || key END) OVER (PARTITION BY conv_id, prompt_turn ORDER BY turn) AS fed FROM replies),
      ends AS (SELECT conv_id, prompt_turn, CASE WHEN conv_id % 2 = 0 THEN min(sec) + 5 ELSE max(sec) + 1 END AS ended FROM replies GROUP BY conv_id, prompt_turn)
      SELECT 'interaction' AS type, 'session-c' || CAST(t.conv_id AS VARCHAR) AS session_id, t.sec * 1000000000 AS start_time_ns,
        greatest(t.sec, coalesce(e.ended, t.sec)) * 1000000000 AS end_time_ns, CAST(NULL AS DOUBLE) AS tokens_in,
        CAST(NULL AS VARCHAR) AS stop_reason, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS tool_input,
        CAST(NULL AS BIGINT) AS reply_blocks, CAST(NULL AS VARCHAR) AS fed
      FROM turns t LEFT JOIN ends e ON e.conv_id = t.conv_id AND e.prompt_turn = t.turn
      UNION ALL
      SELECT 'llm_request', 'session-c' || CAST(conv_id AS VARCHAR), coalesce(1700000000 + conv_id * 1000 + user_turn * 10, sec) * 1000000000,
        (sec + 1) * 1000000000, CAST(length(text) AS DOUBLE), 'tool_use', NULL, NULL, 3, fed FROM fed
      UNION ALL
      SELECT 'tool', 'session-c' || CAST(conv_id AS VARCHAR), (sec + 1) * 1000000000,
        (sec + CASE WHEN answered THEN 3 ELSE 1 END) * 1000000000, NULL, NULL,
        CASE WHEN turn % 5 = 0 THEN 'unknown' ELSE {pick('turn', ['Edit', 'Bash', 'Read'])} END,
        '{{"file_path":"/repo/' || key || '.ts"}}', NULL, NULL FROM replies""",
    "tool_labels": """WITH
      tools(i, name, field, verb, label) AS (VALUES (0, 'Read', 'file', 'read', NULL), (1, 'NotebookRead', 'nb', 'read', NULL),
        (2, 'LS', 'ls', 'list', NULL), (3, 'Edit', 'file', 'edit', NULL), (4, 'MultiEdit', 'file', 'edit', NULL),
        (5, 'Write', 'file', 'write', NULL), (6, 'NotebookEdit', 'nb', 'edit', NULL), (7, 'Glob', NULL, NULL, 'find files'),
        (8, 'Grep', NULL, NULL, 'search files'), (9, 'WebFetch', NULL, NULL, 'fetch web page'), (10, 'WebSearch', NULL, NULL, 'search the web'),
        (11, 'Task', NULL, NULL, 'delegate to subagent'), (12, 'Agent', NULL, NULL, 'delegate to subagent'),
        (13, 'TodoWrite', NULL, NULL, 'update task list'), (14, 'ExitPlanMode', NULL, NULL, 'present plan for approval'),
        (15, 'AskUserQuestion', NULL, NULL, 'ask the user'), (16, 'Skill', NULL, NULL, 'use skill'), (17, 'SlashCommand', NULL, NULL, 'run command'),
        (18, 'ToolSearch', NULL, NULL, 'load tool schema'), (19, 'TaskCreate', NULL, NULL, 'create task'), (20, 'TaskUpdate', NULL, NULL, 'update task'),
        (21, 'SendUserFile', NULL, NULL, 'send file to the user'), (22, 'BashOutput', NULL, NULL, 'read command output'),
        (23, 'KillShell', NULL, NULL, 'kill background command'), (24, 'Bash', NULL, NULL, NULL),
        (25, 'mcp', NULL, NULL, 'mcp__box__open it'), (26, 'Mystery', NULL, NULL, 'mystery')),
      paths(j, path, object) AS (VALUES (0, '/repo/src/a.ts', 'source code'), (1, '/repo/src/a.test.ts', 'unit test'),
        (2, '/repo/x.e2e.test.tsx', 'e2e test'), (3, '/repo/README.md', 'documentation'), (4, '/repo/package.json', 'manifest'),
        (5, '/repo/pnpm-lock.yaml', 'lockfile'), (6, '/repo/.env.local', 'secret / env'), (7, '/repo/data.bin', 'unknown'),
        (8, '/repo/.gitignore', 'VCS artifact'), (9, '/repo/tsconfig.json', 'build config')),
      commands(c, command, did) AS (VALUES (0, 'git status', 'version control'), (1, 'pnpm test', 'run tests'), (2, 'cd /x && rg foo', 'search'),
        (3, 'npm run lint', 'verify'), (4, 'make all', 'build'), (5, 'echo hi', 'run'), (6, 'yarn install', 'build'), (7, 'pnpm exec jest', 'run'),
        (8, '  ', 'run'), (9, 'pytest -x', 'run tests')),
      hosts(h, host) AS (VALUES (0, 'example.org'), (1, 'docs.example.net'), (2, 'odd'), (3, NULL)),
      calls AS (SELECT o_orderkey, name, field, verb, label, object, command, did, host, n, n % 13 <> 0 AS good, n % 11 = 0 AS blank,
          CASE WHEN n % 11 = 0 THEN '  ' WHEN n % 5 = 0 THEN '  ' || path ELSE path END AS raw
        FROM (SELECT o_orderkey, o_orderkey // 27 AS n FROM orders) o JOIN tools ON i = o_orderkey % 27 JOIN paths ON j = n % 10
        JOIN commands ON c = n % 10 JOIN hosts ON h = n % 4),
      looked AS (SELECT *, CASE WHEN good THEN nullif(trim(CASE field WHEN 'file' THEN raw WHEN 'nb' THEN '/nb' || raw WHEN 'ls' THEN '/ls' || raw END), '') END AS raw_path,
          CASE WHEN good AND n % 2 = 0 THEN 'read it' END AS prompt,
          CASE WHEN good AND name = 'NotebookEdit' THEN CASE n % 3 WHEN 0 THEN 'add cell to' WHEN 1 THEN 'delete cell from' ELSE verb END ELSE verb END AS does
        FROM calls),
      headed AS (SELECT o_orderkey, 0 AS sequence_in_node, CASE WHEN verb IS NOT NULL THEN
            CASE WHEN raw_path IS NULL THEN does WHEN blank THEN does || ' unknown' ELSE does || ' ' || object END
          WHEN name = 'Bash' THEN CASE WHEN good THEN did ELSE 'run' END ELSE label END AS action,
          raw_path, CASE WHEN good AND name = 'WebFetch' THEN host END AS url,
          CASE WHEN name = 'WebFetch' THEN prompt WHEN good AND name = 'Bash' AND n % 3 <> 0 THEN 'why ' || CAST(n AS VARCHAR) END AS comment,
          CASE WHEN good THEN command END AS bash_command FROM looked)
      SELECT * FROM headed UNION ALL
      SELECT o_orderkey, 1, 'process result with weak model', NULL, NULL, NULL, command
      FROM looked WHERE name = 'WebFetch' AND prompt IS NOT NULL""",
    "chat_requests": f"""WITH {TALK} SELECT 'session-c' || CAST(h.conv_id AS VARCHAR) AS session_id, h.sec * 1000000000 AS end_time_ns, u.text AS asked
      FROM held h LEFT JOIN conversations u ON u.conv_id = h.conv_id AND u.turn = h.user_turn
      WHERE h.role = 'assistant' AND h.prompt_turn IS NOT NULL""",
    "intent_counts": f"""WITH t0 AS (SELECT {trim('text')} AS clean FROM conversations WHERE role = 'user')
      SELECT {intent_case('clean')} AS intent_category, count(*) AS interactions FROM t0 GROUP BY 1""",
    "document_intents": f"""WITH t0 AS (SELECT doc_id, {trim('text')} AS clean FROM documents)
      SELECT doc_id, {intent_case('clean')} AS intent_category FROM t0""",
    "document_error_kinds": f"""WITH d AS (SELECT doc_id, text, lower(text) AS low, {trim('text')} AS clean,
        length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10ffff}}]')) AS size FROM documents)
      SELECT doc_id, {ERROR_CASE} AS error_kind, nullif(CASE WHEN length(clean) <= 500 THEN clean
          ELSE {rtrim('substr(clean, 1, 499)')} || '…' END, '') AS error_message, size AS output_size FROM d""",
    "decoded_bodies": f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0
      THEN regexp_replace(regexp_replace(text, '{SPACES}', ''), ',$', '') ELSE text END AS text FROM documents""",
    "shell_action": f"""WITH c AS (SELECT o_orderkey, trim({pick('o_orderkey', COMMANDS)}) AS w FROM orders),
      m AS (SELECT o_orderkey, CASE WHEN regexp_matches(w, '^cd\\s+\\S+\\s*(&&|;)\\s*.+$', 'i')
        THEN regexp_replace(w, '^cd\\s+\\S+\\s*(&&|;)\\s*(.+)$', '\\2', 'i') ELSE w END AS w FROM c),
      t AS (SELECT o_orderkey, regexp_split_to_array(w, '\\s+') AS p FROM m),
      h AS (SELECT o_orderkey, p[1] AS head, coalesce(CASE WHEN p[2] IN ('run', 'run-script', 'exec') THEN p[3] ELSE p[2] END, '') AS task FROM t)
      SELECT o_orderkey, {ACTION_CASE} AS action FROM h""",
    "path_type": f"WITH {PATHS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE {PATH_CASE} ELSE 'unknown' END AS path_type FROM bare",
    "repo_path": f"""WITH {PATHS},
      rel AS (SELECT *, CASE WHEN bare <> path THEN bare WHEN cwd IS NOT NULL AND starts_with(path, cwd || '/') THEN substr(path, length(cwd) + 2)
        WHEN path = cwd THEN '' ELSE path END AS rel FROM bare),
      cln AS (SELECT *, ltrim(CASE WHEN contains(rel, '.claude/worktrees/') OR NOT contains(rel, '/.claude/') THEN rel
        ELSE substr(rel, instr(rel, '/.claude/') + 1) END, '/') AS cln FROM rel)
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, nullif(cln, '') AS repo_path,
        nullif(regexp_extract(cln, '(?:^|/)(?:packages|apps|libs)/([^/]+)/', 1, 'i'), '') AS package FROM cln""",
    "url_host": """WITH b AS (SELECT page_id, url, split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/', 1) AS h FROM pages)
      SELECT page_id, CASE WHEN h <> '' THEN h ELSE url END AS host FROM b""",
    "classify_files": f"""SELECT o_orderkey, CASE n WHEN 'a.jsonl' THEN 'native' WHEN 'logs.json' THEN 'otel-log' WHEN 'trace.json' THEN 'otel-trace'
      WHEN 'trace-1.json' THEN 'otel-trace' ELSE 'unsupported' END AS input_type FROM (
      SELECT o_orderkey, {pick('o_orderkey', ['a.jsonl', 'logs.json', 'trace.json', 'trace-1.json', 'trace-x.txt', 'mylogs.json', 'notes.md'])} AS n FROM orders)""",
    "repo_families": f"""WITH d AS (SELECT '-home-me-repo' || CAST(c_custkey // 4 AS VARCHAR) || {pick('c_custkey', ['', '--claude-worktrees-a1', '-.claude-worktrees-b2', '-claude-worktrees-c'])} AS directory FROM customer),
      k AS (SELECT directory, regexp_replace(directory, '-[-.]claude-worktrees-.*$', '') AS repo_key FROM d)
      SELECT repo_key, directory, repo_key <> directory AS is_worktree FROM k""",
    "session_routing": f"""WITH {EV},
      i AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS harness_session, 'native' AS input_type, conv_id AS n FROM conversations
        UNION ALL SELECT CAST(user_id AS VARCHAR), 'otel-trace', event_id FROM ev
        UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'otel-log', user_id FROM ev),
      g AS (SELECT harness_session, input_type, count(*) AS inputs FROM i GROUP BY harness_session, input_type)
      SELECT harness_session, CASE WHEN bool_or(input_type = 'native') OVER (PARTITION BY harness_session) THEN 'native' ELSE 'otel' END AS kind,
        input_type, inputs FROM g""",
}
