"""SQL that gives the registered queries' results on one machine, for checking
them.  Written from the semantics, not from the Spark plans."""

from __future__ import annotations

from ..functions.rules import (INPUT_RULES, OUTPUT_PII_RULES, POLICIES, SANITIZE_RULES, SECRET_RULES, Policy)
from ..operators.access import EXTRA_OUTPUT_RULES
from . import catalog as c
from .payloads import OUTPUT_PAYLOADS, REQUEST_PAYLOADS, RULE_PAYLOADS, literal, sql_payload

US = "epoch_us(ts)"
PLANTED = f"planted AS (SELECT doc_id, lang, source, {sql_payload('text', 'doc_id', RULE_PAYLOADS)} AS t FROM documents)"


def _hit(text: str, rule) -> str:
    return f"regexp_matches({text}, {literal(rule.pattern)})"


def _replace(text: str, rules) -> str:
    for r in rules:
        text = f"regexp_replace({text}, {literal(r.pattern)}, '[REDACTED_{r.category}]', 'g')"
    return text


def _count(hits) -> str:
    return " + ".join(f"({h})::BIGINT" for h in hits) or "0"


def _size(text: str) -> str:
    return f"octet_length(encode({text}))::BIGINT"


def _listed(rules, text: str) -> str:
    """Matches of every rule as one list of (category, length), rule order."""
    parts = [f"list_transform(regexp_extract_all({text}, {literal(r.pattern)}), "
             f"lambda m: {{'category': '{r.category}', 'len': {_size('m')}}})" for r in rules]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


# -- detection -----------------------------------------------------------------
def _rule_rows(source: str, key: str, text: str, category: str | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, {i} AS rule, '{r.category}' AS category, {literal(r.description)} AS description, "
        f"'{r.severity}' AS severity FROM {source} WHERE {_hit(text, r)}"
        for i, r in enumerate(INPUT_RULES) if category in (None, r.category))


def _hit_rows(category: str) -> str:
    return f"WITH {PLANTED} SELECT doc_id, description, severity FROM ({_rule_rows('planted', 'doc_id', 't', category)})"


def _any(category: str) -> str:
    return "(" + " OR ".join(_hit("t", r) for r in INPUT_RULES if r.category == category) + ")"


_LONG = f"{_size('t')} > {c.SHORT_TOKENS * 4}"
_N_RULES = _count([_hit("t", r) for r in INPUT_RULES])
_SANITIZED = _replace("t", SANITIZE_RULES)

V = {
    "v_length": f"SELECT doc_id, {_size('text')} AS n_bytes, {_size('text')} > {c.SHORT_TOKENS * 4} AS too_long FROM documents",
    "v_injection_hits": _hit_rows("INJECTION"),
    "v_code_hits": _hit_rows("MALICIOUS_CODE"),
    "v_pii_hits": _hit_rows("PII"),
    "v_rule_report": f"SELECT lang, rule::BIGINT AS rule, category, description, count(*) AS texts "
                     f"FROM ({_rule_rows('documents', 'lang', 'text')}) GROUP BY ALL",
    "v_pages_report": f"SELECT rule::BIGINT AS rule, category, description, count(*) AS texts "
                      f"FROM ({_rule_rows('pages', 'page_id', 'html')}) GROUP BY rule, category, description",
    "v_validate_summary": f"""
        WITH {PLANTED}, s AS (
            SELECT lang, {_LONG} AS long, {_any('INJECTION')} AS inj, {_any('MALICIOUS_CODE')} AS code,
                   {_any('PII')} AS pii, {_N_RULES} AS n FROM planted)
        SELECT lang, count(*) AS texts, count(*) FILTER (WHERE long OR n > 0) AS invalid,
               sum(n + long::BIGINT)::BIGINT AS violations, count(*) FILTER (WHERE long) AS too_long,
               count(*) FILTER (WHERE inj) AS injection, count(*) FILTER (WHERE code) AS malicious_code,
               count(*) FILTER (WHERE pii) AS pii
        FROM s GROUP BY lang""",
    "v_violation_list": f"""
        WITH {PLANTED}, hit AS (
            SELECT doc_id, -1 AS rule, 'LENGTH' AS category, 'Input exceeds max length (' || {_size('t')} ||
                   ' > {c.SHORT_TOKENS * 4})' AS description, 'high' AS severity FROM planted WHERE {_LONG}
            UNION ALL {_rule_rows('planted', 'doc_id', 't')})
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule) - 1 AS position,
               category, description, severity FROM hit""",
    "v_validate": f"WITH {PLANTED} SELECT doc_id, {_N_RULES} + ({_LONG})::BIGINT = 0 AS valid, {_SANITIZED} AS sanitized, "
                  f"{_N_RULES} + ({_LONG})::BIGINT AS n_violations FROM planted",
    "v_sanitize": f"WITH {PLANTED} SELECT doc_id, {_SANITIZED} AS sanitized FROM planted",
}


# -- redaction -----------------------------------------------------------------
def _redacted(source: str, keys: str, text: str, secrets=SECRET_RULES, personal=OUTPUT_PII_RULES) -> str:
    """CTEs ending in `red` (keys, text, redacted, found)."""
    first = _listed(secrets, text) if secrets else "[]"
    second = _listed(personal, "snap") if personal else "[]"
    return (f"snaps AS (SELECT {keys}, {text} AS original, {_replace(text, secrets)} AS snap, {first} AS f1 FROM {source}), "
            f"red AS (SELECT {keys}, original, {_replace('snap', personal)} AS redacted, "
            f"list_concat(f1, {second}) AS found FROM snaps)")


def _report(source: str, keys: str, text: str) -> str:
    return (f"{_redacted(source, keys, text)}, hits AS (SELECT {keys}, unnest(found) AS h FROM red) "
            f"SELECT {keys}, h.category AS category, count(*) AS hits, sum(h.len)::BIGINT AS hit_bytes FROM hits GROUP BY ALL")


OUTPUTS = (f"outputs AS (SELECT -(conv_id * 100 + turn) - 1 AS seq, (1704067200 + conv_id) * 1000000 AS us, "
           f"{sql_payload('text', '(conv_id + turn)', OUTPUT_PAYLOADS)} AS text FROM conversations WHERE role = 'assistant')")

F = {
    "f_secret_redact": f"WITH {PLANTED}, {_redacted('planted', 'doc_id', 't', personal=())} "
                       "SELECT doc_id, redacted, len(found) > 0 AS modified FROM red",
    "f_pii_redact": f"WITH {PLANTED}, {_redacted('planted', 'doc_id', 't', secrets=())} "
                    "SELECT doc_id, redacted, len(found) > 0 AS modified FROM red",
    "f_redact_text": f"WITH {PLANTED}, {_redacted('planted', 'doc_id', 't')} "
                     "SELECT doc_id, redacted, len(found) > 0 AS modified, len(found)::BIGINT AS n_redactions FROM red",
    "f_redaction_list": f"WITH {PLANTED}, {_redacted('planted', 'doc_id', 't')}, "
                        "h AS (SELECT doc_id, unnest(found) AS h, generate_subscripts(found, 1) AS i FROM red) "
                        "SELECT doc_id, (i - 1)::BIGINT AS position, h.category AS category, h.len AS original_length FROM h",
    "f_report": f"WITH {PLANTED}, {_report('planted', 'lang', 't')}",
    "f_report_natural": f"WITH {_report('documents', 'lang, source', 'text')}",
    "f_report_quality": f"WITH labelled AS (SELECT l.quality, d.text FROM documents d JOIN labels l USING (doc_id)), "
                        f"{_report('labelled', 'quality', 'text')}",
    "f_outputs": f"WITH {OUTPUTS}, {_redacted('outputs', 'seq', 'text')} "
                 "SELECT seq, redacted, len(found) > 0 AS modified FROM red",
    "f_disabled": f"WITH {OUTPUTS} SELECT seq, text AS redacted, false AS modified, true AS unlisted FROM outputs",
    "f_extra_kinds": f"WITH {PLANTED}, {_redacted('planted', 'doc_id', 't', (), EXTRA_OUTPUT_RULES)} "
                     "SELECT doc_id, redacted, len(found)::BIGINT AS n_redactions FROM red",
}


# -- policies ------------------------------------------------------------------
def _policy_counts(hit) -> str:
    def count(*actions):
        return _count([hit(p) for p in c.ALL_POLICIES if p.action in actions])
    return (f"{count('block')} = 0 AS allowed, {count('block', 'redact')} AS n_violations, {count('warn')} AS n_warnings")


def _policy_rows(source: str, key: str, text: str, policies=c.ALL_POLICIES) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, {i} AS ord, {literal(p.name)} AS policy, '{p.action}' AS action, {literal(p.description)} AS description "
        f"FROM {source} WHERE {_hit(text, p)}" for i, p in enumerate(policies))


def _named(p: Policy) -> str:
    subset = ("CASE doc_id % 4 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['no_xxe', 'unknown', 'no_sql_injection'] "
              "WHEN 3 THEN ['no_command_injection', 'topsecret_marker'] END")
    return f"coalesce(list_contains({subset}, '{p.name}'), true) AND {_hit('t', p)}"


def _nth(values: list[str], index: str) -> str:
    return f"([{', '.join(literal(v) for v in values)}])[{index} % {len(values)} + 1]"


_BAD = ("(", "a(?=b)", "(?=x)", "[")
_DEFAULTS = ", ".join(
    f"({i - len(POLICIES)}, 'add', {literal(p.name)}, {literal(p.pattern)}, '{p.action}', {literal(p.description)})"
    for i, p in enumerate(POLICIES))
CHANGES = f"""
    raw AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op,
                   CASE WHEN event_id % 13 = 0 THEN {_nth([p.name for p in POLICIES], 'event_id')} ELSE 'p' || user_id END AS name,
                   {_nth(c.CHANGE_PATTERNS, 'event_id')} AS pattern, {_nth(c.CHANGE_ACTIONS, 'event_id')} AS action,
                   event_type AS description FROM events),
    effect AS (SELECT * FROM raw WHERE op = 'remove' OR (pattern NOT IN ({', '.join(map(literal, _BAD))}) AND action <> 'deny')),
    defaults(seq, op, name, pattern, action, description) AS (VALUES {_DEFAULTS})"""
_LAST = "QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1"

P = {
    "p_evaluate": f"WITH {PLANTED} SELECT doc_id, {_policy_counts(lambda p: _hit('t', p))} FROM planted",
    "p_routing": f"""
        WITH {PLANTED}, h AS ({_policy_rows('planted', 'doc_id', 't')})
        SELECT doc_id, NOT bool_or(action = 'block') OVER (PARTITION BY doc_id) AS allowed,
               CASE WHEN action = 'warn' THEN 'warning' ELSE 'violation' END AS kind, policy, action, description FROM h""",
    "p_subset": f"WITH {PLANTED} SELECT doc_id, {_policy_counts(_named)} FROM planted",
    "p_hits": f"""
        WITH {PLANTED}, h AS ({_policy_rows('planted', 'doc_id', 't')})
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS position, policy, action, description FROM h""",
    "p_rule_join": f"WITH {PLANTED}, h AS ({_policy_rows('planted', 'doc_id', 't')}) SELECT doc_id, policy, action, description FROM h",
    "p_pages": f"SELECT page_id, policy, action FROM ({_policy_rows('pages', 'page_id', 'html')})",
    "p_upsert": f"""
        WITH {CHANGES}, latest AS (SELECT * FROM (SELECT * FROM defaults UNION ALL SELECT * FROM effect) {_LAST})
        SELECT seq::BIGINT AS ord, name, pattern, action, description FROM latest WHERE op = 'add'""",
    "p_remove": f"""
        WITH {CHANGES} SELECT doc_id AS ord, 'p' || doc_id AS name, lang AS pattern, 'warn' AS action FROM documents
        WHERE 'p' || doc_id NOT IN (SELECT name FROM raw WHERE op = 'remove')""",
    "p_versions": f"""
        WITH {CHANGES}, steps AS (
            SELECT seq + 1 AS from_seq, lead(seq + 1) OVER (PARTITION BY name ORDER BY seq) AS to_seq, name, op, action
            FROM (SELECT * FROM defaults UNION ALL SELECT * FROM effect))
        SELECT from_seq::BIGINT AS from_seq, to_seq::BIGINT AS to_seq, name, action FROM steps WHERE op = 'add'""",
}


# -- limiter -------------------------------------------------------------------
def _limiter(source: str, window: int, limit: str, name: str = "lim") -> str:
    """Recursive CTEs over *source* (seq, us, user_id and, if used in *limit*,
    its columns): one step per request of a user."""
    w = f"list_filter(k.kept, lambda x: o.us - x < {window})"
    return f"""
    ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS rn FROM {source}),
    walk AS (
        SELECT user_id, rn, seq, [us] AS kept, false AS limited, NULL::BIGINT AS retry_after FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.user_id, o.rn, o.seq,
               CASE WHEN len({w}) >= {limit} THEN {w} ELSE list_append({w}, o.us) END,
               len({w}) >= {limit},
               CASE WHEN len({w}) >= {limit} THEN ({window} - (o.us - {w}[1])) // 1000000 + 1 END
        FROM walk k JOIN ordered o ON o.user_id = k.user_id AND o.rn = k.rn + 1),
    {name} AS (SELECT seq, user_id, limited, retry_after FROM walk)"""


def _limited_events(user: str, limit: int = c.LIMIT) -> str:
    return (f"WITH RECURSIVE ev AS (SELECT event_id AS seq, {US} AS us, {user} AS user_id FROM events), "
            + _limiter("ev", c.DAY_US, str(limit)))


_USER = "user_id::VARCHAR"
_USER_50 = "CASE WHEN event_id % 50 = 0 THEN 'anonymous' ELSE user_id::VARCHAR END"
R = {
    "r_limiter": f"{_limited_events(_USER)} SELECT seq, limited FROM lim",
    "r_retry_after": f"{_limited_events(_USER)} SELECT seq, user_id, retry_after FROM lim WHERE limited",
    "r_default_key": f"{_limited_events(_USER_50)} SELECT seq, limited, retry_after FROM lim",
    "r_hot_key": _limited_events("CASE WHEN event_id % 3 = 0 THEN 'anonymous' ELSE user_id::VARCHAR END", 20)
                 + " SELECT seq, limited, retry_after FROM lim",
    "r_tenant": _limited_events("user_id || '/' || event_type", 1) + " SELECT seq, limited, retry_after FROM lim",
    "r_active_users": f"SELECT count(DISTINCT {_USER_50}) AS active_users FROM events",
    "r_stream_batches": f"{_limited_events(_USER_50)} SELECT seq, limited, retry_after FROM lim",
    "r_stream": f"{_limited_events(_USER)} SELECT seq, limited, retry_after FROM lim",
}


# -- gate ----------------------------------------------------------------------
TURNS = """turns AS (SELECT conv_id, text AS turn_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at,
                         count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations WHERE role = 'user'),
    picked AS (SELECT events.*, coalesce(turn_text, '') AS turn_text FROM events CROSS JOIN (SELECT max(conv_id) + 1 AS convs FROM conversations)
               LEFT JOIN turns ON turns.conv_id = event_id % convs AND turns.at = (event_id // convs) % turns.turns)"""
REQUESTS = f"""{TURNS},
    req AS (SELECT event_id AS seq, {US} AS us, {_USER_50} AS user_id,
                   {sql_payload('turn_text', 'event_id', REQUEST_PAYLOADS)} AS text
            FROM picked)"""


def _counted(source: str = "req") -> str:
    def count(*actions):
        return _count([_hit("text", p) for p in c.ALL_POLICIES if p.action in actions])
    return f"""
    counted AS (SELECT *, {_count([_hit('text', r) for r in INPUT_RULES])}
                       + ({_size('text')} > {c.GATE_TOKENS * 4})::BIGINT AS n_viol,
                       {count('block')} AS n_block, {count('block', 'redact')} AS n_pol, {count('warn')} AS n_warn FROM {source})"""


def _coded(off: str = "") -> str:
    """CTE `coded`: request columns, code and the three counts."""
    limiter = "false" if off == "enable_rate_limiting" else "l.limited"
    validates, judges = (str(off != s).lower() for s in ("enable_input_validation", "enable_policy_enforcement"))
    return f"""
    judged AS (SELECT q.*, l.retry_after, {limiter} AS over, {validates} AS validates, {judges} AS judges
               FROM counted q JOIN lim l USING (seq)),
    codes AS (SELECT *, CASE WHEN over THEN 'RATE_LIMIT' WHEN validates AND n_viol > 0 THEN 'VALIDATION_ERROR'
                             WHEN judges AND n_block > 0 THEN 'POLICY_VIOLATION' END AS code FROM judged),
    coded AS (SELECT * EXCLUDE (retry_after, over), CASE WHEN over THEN retry_after END AS retry_after,
                     CASE WHEN validates AND NOT over THEN n_viol END AS n_violations,
                     CASE WHEN judges AND coalesce(code, '') IN ('', 'POLICY_VIOLATION') THEN n_pol END AS n_policy_violations,
                     CASE WHEN judges AND coalesce(code, '') IN ('', 'POLICY_VIOLATION') THEN n_warn END AS n_warnings
              FROM codes)"""


_REASON = """CASE code WHEN 'RATE_LIMIT' THEN 'Rate limit exceeded, retry after ' || retry_after || 's'
             WHEN 'VALIDATION_ERROR' THEN 'Input validation failed' WHEN 'POLICY_VIOLATION' THEN 'Policy violation' END"""
_GATE_LIMITER = _limiter("req", c.DAY_US, str(c.LIMIT))
GATED = f"WITH RECURSIVE {REQUESTS}, {_counted()}, {_GATE_LIMITER}, {_coded()}"
_VERDICT = f"""SELECT seq, 'gr_' || md5('request:' || seq) AS request_id, user_id, code IS NULL AS allowed, code,
               {_REASON} AS reason, n_violations, n_policy_violations, n_warnings"""


def _fired(actions: tuple[str, ...], text: str = "text") -> str:
    parts = ", ".join(f"CASE WHEN {_hit(text, p)} THEN '{p.name}' END" for p in c.ALL_POLICIES if p.action in actions)
    return f"concat_ws(',', {parts})"


def _records(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


_VALIDATION = f"""{{'valid': n_violations = 0, 'sanitized': {_replace('text', SANITIZE_RULES)}, 'violations': """ + _records(
    [f"CASE WHEN {_size('text')} > {c.GATE_TOKENS * 4} THEN {{'category': 'LENGTH', 'description': "
     f"'Input exceeds max length (' || {_size('text')} || ' > {c.GATE_TOKENS * 4})', 'severity': 'high'}} END"]
    + [f"CASE WHEN {_hit('text', r)} THEN {{'category': '{r.category}', 'description': {literal(r.description)}, "
       f"'severity': '{r.severity}'}} END" for r in INPUT_RULES]) + "}"


def _policy_list(warnings: bool) -> str:
    return _records([f"CASE WHEN {_hit('text', p)} THEN {{'policy': '{p.name}', 'action': '{p.action}', "
                     f"'description': {literal(p.description)}}} END"
                     for p in c.ALL_POLICIES if (p.action == "warn") == warnings])


_POLICY = f"{{'allowed': n_block = 0, 'violations': {_policy_list(False)}, 'warnings': {_policy_list(True)}}}"


def _switched(off: str) -> str:
    return f"""SELECT '{off}' AS off, seq, code, n_violations, n_policy_violations, n_warnings FROM (
        WITH {_coded(off).strip()} SELECT * FROM coded)"""


G = {
    "g_verdict": f"{GATED} {_VERDICT}, retry_after FROM coded",
    "g_codes": f"{GATED} SELECT coalesce(code, 'ALLOWED') AS code, code IS NULL AS allowed, count(*) AS requests FROM coded GROUP BY ALL",
    "g_detail": f"""{GATED} SELECT seq, code, n_violations = 0 AS valid,
        CASE WHEN n_violations IS NOT NULL THEN {_replace('text', SANITIZE_RULES)} END AS sanitized,
        n_violations AS listed_violations, CASE WHEN n_warnings IS NOT NULL THEN n_block = 0 END AS policy_allowed,
        CASE WHEN n_warnings IS NOT NULL THEN {_fired(('block', 'redact'))} END AS policy_violations,
        CASE WHEN n_warnings IS NOT NULL THEN {_fired(('warn',))} END AS policy_warnings FROM coded""",
    "g_switches": f"WITH RECURSIVE {REQUESTS}, {_counted()}, {_GATE_LIMITER} " + " UNION ALL ".join(
        _switched(s) for s in ("enable_rate_limiting", "enable_input_validation", "enable_policy_enforcement")),
    "g_stream": f"{GATED} {_VERDICT} FROM coded",
}


# -- audit ---------------------------------------------------------------------
def _request_events(source: str) -> str:
    return f"""SELECT seq, CASE code WHEN 'RATE_LIMIT' THEN 'RATE_LIMIT_EXCEEDED' WHEN 'VALIDATION_ERROR' THEN 'INPUT_BLOCKED'
                    WHEN 'POLICY_VIOLATION' THEN 'POLICY_VIOLATION' ELSE 'INPUT_PROCESSED' END AS event_type, us,
             CASE code WHEN 'RATE_LIMIT' THEN 'retry_after=' || retry_after || 's' WHEN 'VALIDATION_ERROR' THEN n_violations || ' violations'
                  WHEN 'POLICY_VIOLATION' THEN n_policy_violations || ' violations' ELSE 'ok' END AS details, user_id FROM {source}"""


AUDIT = f"""{GATED}, {OUTPUTS}, {_redacted('outputs', 'seq, us', 'text')},
    log AS ({_request_events('coded')}
            UNION ALL SELECT seq, 'OUTPUT_FILTERED', us, len(found) || ' redactions', 'system' FROM red),
    audit AS (SELECT *, (contains(event_type, 'BLOCKED') OR contains(event_type, 'VIOLATION')
                         OR contains(event_type, 'RATE_LIMIT')) AS blocked FROM log)"""
_EVENTS = "SELECT seq, 'gr_' || md5('audit:' || seq) AS id, event_type, us, details, user_id FROM audit"
_KEPT = f"(SELECT * FROM audit ORDER BY seq DESC LIMIT {c.KEEP})"
_PAGE = "SELECT seq, event_type, details, user_id FROM"
_COUNTS = """count(*) AS events, count(*) FILTER (WHERE blocked) AS blocked,
             count(*) FILTER (WHERE event_type = 'RATE_LIMIT_EXCEEDED') AS rate_limit_hits"""


def _window(us: str, days: int = 1) -> str:
    return f"({us} // {days * c.DAY_US} * {days * c.DAY_US})::BIGINT"


A = {
    "a_events": f"{AUDIT} {_EVENTS}",
    "a_retention": f"{AUDIT} SELECT seq, event_type, details FROM {_KEPT}",
    "a_retention_days": f"{AUDIT} SELECT seq, event_type, details FROM {_KEPT}",
    "a_logs_newest": f"{AUDIT} {_PAGE} audit ORDER BY seq DESC LIMIT 50",
    "a_logs_by_type": f"{AUDIT} {_PAGE} {_KEPT} WHERE event_type = 'INPUT_BLOCKED' ORDER BY seq DESC LIMIT 20",
    "a_totals": f"{AUDIT} SELECT count(*) AS total_requests, count(*) FILTER (WHERE blocked) AS blocked_requests FROM audit",
    "a_stats": f"""{AUDIT} SELECT (SELECT count(DISTINCT user_id) FROM req) AS active_users, count(*) AS total_requests,
        count(*) FILTER (WHERE blocked) AS blocked_requests, true AS enable_input_validation, true AS enable_output_filtering,
        true AS enable_policy_enforcement, true AS enable_rate_limiting, {c.LIMIT} AS max_requests_per_minute,
        {c.GATE_TOKENS} AS max_tokens_per_request FROM audit""",
    "a_rollup": f"{AUDIT} SELECT {_window('us')} AS window_us, event_type, {_COUNTS} FROM audit GROUP BY 1, 2",
    "a_rollup_users": f"{AUDIT} SELECT {_window('us', 7)} AS window_us, user_id, {_COUNTS} FROM audit GROUP BY 1, 2",
    "a_stream": f"""
        WITH ev AS (SELECT {US} AS us, CASE event_type WHEN 'error' THEN 'INPUT_BLOCKED' WHEN 'view' THEN 'RATE_LIMIT_EXCEEDED'
                           ELSE 'INPUT_PROCESSED' END AS event_type FROM events),
             log AS (SELECT *, event_type <> 'INPUT_PROCESSED' AS blocked FROM ev),
             rolled AS (SELECT {_window('us')} AS window_us, event_type, {_COUNTS} FROM log GROUP BY 1, 2)
        SELECT * FROM rolled""",
}


# -- configuration and replay --------------------------------------------------
_PATCH_FIELDS = {
    "max_requests_per_minute": ("CASE WHEN event_type = 'error' AND event_id % 7 - 1 >= 1 THEN event_id % 7 - 1 END", "60"),
    "max_tokens_per_request": ("CASE WHEN event_type = 'click' AND (event_id % 5) * 100 - 100 >= 0 THEN (event_id % 5) * 100 - 100 END", "100000"),
    "enable_input_validation": ("CASE WHEN event_type = 'view' THEN event_id % 3 = 0 END", "true"),
    "enable_output_filtering": ("CASE WHEN event_type = 'signup' THEN event_id % 2 = 0 END", "true"),
    "enable_policy_enforcement": ("CASE WHEN event_type = 'signup' AND event_id % 4 < 2 THEN event_id % 3 = 1 END", "true"),
    "enable_rate_limiting": ("CASE WHEN event_type = 'purchase' THEN event_id % 4 = 0 END", "true"),
}
C_HISTORY = "SELECT event_id AS seq, " + ", ".join(
    f"coalesce(last_value({patch} IGNORE NULLS) OVER (ORDER BY event_id), {default}) AS {field}"
    for field, (patch, default) in _PATCH_FIELDS.items()) + " FROM events"

_TOOL = """CASE WHEN n % 101 BETWEEN 1 AND 4 THEN NULL WHEN n % 101 = 5 THEN 'unknown_tool' WHEN n % 97 = 0 THEN 'update_config'
           WHEN n % 89 = 0 THEN 'add_policy' WHEN n % 83 = 0 THEN 'remove_policy' WHEN n % 10 = 3 THEN 'filter_output'
           WHEN n % 10 = 4 THEN 'check_policy' ELSE 'validate_input' END"""
CALLS = f"""{TURNS},
    raw AS (SELECT event_id AS n, {US} AS us, user_id, {sql_payload('turn_text', 'event_id', REQUEST_PAYLOADS)} AS raw_text
            FROM picked),
    tooled AS (SELECT *, {_TOOL} AS tool FROM raw),
    calls AS (
        SELECT n AS seq, us, tool, tool <> 'unknown_tool' AS known,
               CASE WHEN tool = 'validate_input' AND n % 10 = 5 THEN ''
                    WHEN tool IN ('validate_input', 'filter_output', 'check_policy', 'unknown_tool') THEN raw_text ELSE '' END AS text,
               CASE WHEN tool = 'validate_input' AND n % 10 <> 5 THEN user_id::VARCHAR ELSE 'anonymous' END AS user_id,
               CASE WHEN tool = 'check_policy' AND n % 20 = 4 THEN ['no_xxe', 'no_command_injection', 'p4'] END AS names,
               CASE WHEN tool IN ('add_policy', 'remove_policy') THEN
                    CASE WHEN n % 3 = 0 THEN 'no_path_traversal' ELSE 'p' || (n % 11) END ELSE '' END AS name,
               CASE WHEN tool = 'add_policy' THEN {_nth(c.REPLAY_PATTERNS, 'n')} ELSE '' END AS pattern,
               CASE WHEN tool = 'add_policy' THEN {_nth(c.CHANGE_ACTIONS, 'n')} ELSE 'block' END AS action,
               CASE WHEN tool = 'update_config' AND n % 2 = 0 THEN n % 5 END AS max_requests_per_minute,
               CASE WHEN tool = 'update_config' AND n % 5 = 1 THEN n % 90 END AS max_tokens,
               CASE WHEN tool = 'update_config' AND n % 7 = 2 THEN n % 4 <> 0 END AS enable_rate_limiting,
               CASE WHEN tool = 'update_config' AND n % 5 = 4 THEN n % 3 <> 0 END AS judges,
               CASE WHEN tool = 'update_config' AND n % 5 = 3 THEN n % 2 = 0 END AS filters
        FROM tooled WHERE tool IS NOT NULL)"""


def _as_of(value: str, default: str, name: str) -> str:
    return (f"coalesce(last_value({value} IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
            f"{default}) AS {name}")


GOVERNED = f"""{CALLS},
    governed AS (SELECT seq, us, tool, text, user_id, names,
        {_as_of('CASE WHEN max_requests_per_minute >= 1 THEN max_requests_per_minute END', '60', 'cap')},
        {_as_of('max_tokens', '100000', 'tokens')}, {_as_of('enable_rate_limiting', 'true', 'limits')},
        {_as_of('judges', 'true', 'judges')}, {_as_of('filters', 'true', 'filters')} FROM calls),
    changes AS (
        SELECT seq, op, name, pattern, action FROM (VALUES {_DEFAULTS}) d(seq, op, name, pattern, action, description)
        UNION ALL SELECT seq, CASE tool WHEN 'add_policy' THEN 'add' ELSE 'remove' END, name, pattern, action FROM calls
        WHERE tool = 'remove_policy' OR (tool = 'add_policy' AND action <> 'deny' AND pattern NOT IN ({', '.join(map(literal, _BAD))}))),
    versions AS (SELECT seq AS since, lead(seq) OVER (PARTITION BY name ORDER BY seq) AS until, op, name, pattern, action FROM changes),
    hit AS (SELECT g.seq, v.since, v.name, v.action FROM governed g JOIN versions v
            ON v.op = 'add' AND g.seq > v.since AND (v.until IS NULL OR g.seq <= v.until)
            WHERE g.tool IN ('validate_input', 'check_policy') AND (g.names IS NULL OR list_contains(g.names, v.name))
              AND regexp_matches(g.text, v.pattern)),
    hits AS (SELECT seq, count(*) FILTER (WHERE action = 'block') AS n_block, count(*) FILTER (WHERE action <> 'warn') AS n_pol,
                    count(*) FILTER (WHERE action = 'warn') AS n_warn, string_agg(name, ',' ORDER BY since) AS policies
             FROM hit GROUP BY seq),
    judged_calls AS (SELECT g.*, coalesce(n_block, 0) AS n_block, coalesce(n_pol, 0) AS n_pol, coalesce(n_warn, 0) AS n_warn,
                     coalesce(policies, '') AS policies FROM governed g LEFT JOIN hits USING (seq))"""
_REPLAYED = f"""WITH RECURSIVE {GOVERNED},
    checked AS (SELECT *, {_count([_hit('text', r) for r in INPUT_RULES])} + ({_size('text')} > tokens * 4)::BIGINT AS n_viol
                FROM judged_calls WHERE tool = 'validate_input'),
    live AS (SELECT seq, us, user_id, cap FROM checked WHERE limits),
    {_limiter('live', c.REPLAY_WINDOW_US, 'o.cap')},
    codes AS (SELECT k.*, l.retry_after, coalesce(l.limited, false) AS over,
                     CASE WHEN coalesce(l.limited, false) THEN 'RATE_LIMIT' WHEN n_viol > 0 THEN 'VALIDATION_ERROR'
                          WHEN judges AND n_block > 0 THEN 'POLICY_VIOLATION' END AS code
              FROM checked k LEFT JOIN lim l USING (seq)),
    coded AS (SELECT *, CASE WHEN NOT over THEN n_viol END AS n_violations,
                     judges AND coalesce(code, '') IN ('', 'POLICY_VIOLATION') AS judged FROM codes),
    verdicts AS (SELECT * EXCLUDE (policies), CASE WHEN judged THEN n_pol END AS n_policy_violations,
                        CASE WHEN judged THEN n_warn END AS n_warnings, CASE WHEN judged THEN policies END AS policies FROM coded)"""
_FILTERED = _redacted("governed", "seq, us, tool, filters", "text")

C = {
    "c_history": C_HISTORY,
    "c_replay": f"""{_REPLAYED} SELECT seq, user_id, code IS NULL AS allowed, code, {_REASON} AS reason,
                    n_violations, n_policy_violations, n_warnings, policies FROM verdicts""",
    "c_replay_checks": f"""WITH {GOVERNED} SELECT seq, n_block = 0 AS allowed, n_pol AS n_policy_violations,
                    n_warn AS n_warnings, policies FROM judged_calls WHERE tool = 'check_policy'""",
    "c_replay_outputs": f"""WITH {GOVERNED}, {_FILTERED} SELECT seq, filters AND len(found) > 0 AS modified,
                    CASE WHEN filters THEN redacted ELSE original END AS redacted,
                    CASE WHEN filters THEN len(found)::BIGINT END AS n_redactions FROM red WHERE tool = 'filter_output'""",
    "c_replay_audit": f"""{_REPLAYED}, {_FILTERED}, log AS ({_request_events('verdicts')}
                    UNION ALL SELECT seq, 'OUTPUT_FILTERED', us, len(found) || ' redactions', 'system' FROM red
                    WHERE tool = 'filter_output' AND filters) SELECT seq, event_type, details, user_id FROM log""",
}

C["c_replay_stream"] = C["c_replay"]
_SETTINGS = """settings AS (SELECT seq,
        coalesce(last_value(CASE WHEN max_requests_per_minute >= 1 THEN max_requests_per_minute END IGNORE NULLS) OVER w, 60) AS cap,
        coalesce(last_value(max_tokens IGNORE NULLS) OVER w, 100000) AS tokens, coalesce(last_value(enable_rate_limiting IGNORE NULLS) OVER w, true) AS limits,
        coalesce(last_value(judges IGNORE NULLS) OVER w, true) AS judges, coalesce(last_value(filters IGNORE NULLS) OVER w, true) AS filters
        FROM calls WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
C["c_replay_stats"] = f"""{_REPLAYED}, {_SETTINGS},
    log AS (SELECT seq, code IS NOT NULL AS blocked FROM verdicts UNION ALL SELECT seq, false FROM governed WHERE tool = 'filter_output' AND filters),
    firsts AS (SELECT user_id, min(seq) AS first FROM checked WHERE limits GROUP BY user_id),
    asks AS (SELECT event_id AS n FROM events WHERE event_id % 9 = 1)
    SELECT 2 * n + 1 AS seq, (SELECT count(*) FROM firsts WHERE first <= n) AS active_users, (SELECT count(*) FROM log WHERE log.seq <= n) AS total_requests,
           (SELECT count(*) FROM log WHERE log.seq <= n AND blocked) AS blocked_requests, true AS enable_input_validation,
           coalesce(s.filters, true) AS enable_output_filtering, coalesce(s.judges, true) AS enable_policy_enforcement,
           coalesce(s.limits, true) AS enable_rate_limiting, coalesce(s.cap, 60) AS max_requests_per_minute, coalesce(s.tokens, 100000) AS max_tokens_per_request
    FROM asks ASOF LEFT JOIN settings s ON asks.n >= s.seq"""
C["c_replay_logs"] = f"""{_REPLAYED}, {_FILTERED}, log AS ({_request_events('verdicts')}
    UNION ALL SELECT seq, 'OUTPUT_FILTERED', us, len(found) || ' redactions', 'system' FROM red WHERE tool = 'filter_output' AND filters),
    ranked AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM log),
    asks AS (SELECT event_id AS n, ([NULL, {', '.join(literal(t) for t in c.ASKED_TYPES[1:])}])[event_id % {len(c.ASKED_TYPES)} + 1] AS kind,
                    CASE WHEN event_id % 11 BETWEEN 1 AND 8 THEN event_id % 7 * 10 ELSE 50 END AS most,
                    (SELECT count(*) FROM log WHERE seq <= event_id) AS upto FROM events WHERE event_id % 9 = 4),
    found AS (SELECT n, most, ranked.*, row_number() OVER (PARTITION BY n ORDER BY r DESC) - 1 AS position
              FROM asks JOIN ranked ON r <= upto AND r > upto - {c.KEEP} AND (kind IS NULL OR event_type = kind))
    SELECT 2 * n + 1 AS ask, position, 2 * seq AS seq, event_type, details, user_id FROM found WHERE position < most"""

S = {
    "s_call_log": f"""WITH {CALLS} SELECT seq, tool, known, text, user_id, array_to_string(names, ',') AS policy_names,
                    50::BIGINT AS "limit", name, pattern, action, max_requests_per_minute, enable_rate_limiting,
                    NULL::BOOLEAN AS enable_input_validation FROM calls""",
    "s_rejected_lines": "SELECT event_id AS seq, CASE WHEN event_id % 101 = 2 THEN 'json' ELSE 'shape' END AS reason FROM events WHERE event_id % 101 IN (2, 3)",
    "s_audit_sink": f"{AUDIT} {_EVENTS}",
    "s_verdict_json": f"""{GATED}, parts AS (
            SELECT seq, code, 'gr_' || md5('request:' || seq) AS request_id, {_REASON} AS reason,
                   CASE WHEN n_violations IS NOT NULL THEN {_VALIDATION} END AS validation,
                   CASE WHEN n_warnings IS NOT NULL THEN {_POLICY} END AS policy FROM coded)
        SELECT seq, CASE WHEN code IS NULL
            THEN to_json({{'allowed': true, 'request_id': request_id, 'validation': validation, 'policy': policy}})
            ELSE to_json({{'allowed': false, 'request_id': request_id, 'reason': reason, 'code': code,
                          'validation': validation, 'policy': policy}}) END::VARCHAR AS verdict FROM parts""",
}


# -- access rules --------------------------------------------------------------
_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
D = {
    "d_user_time": f"""{AUDIT} SELECT seq, event_type, details FROM audit WHERE user_id = 'anonymous'
        AND us >= epoch_us(TIMESTAMP '2024-01-10') AND us < epoch_us(TIMESTAMP '2024-01-25') ORDER BY seq DESC LIMIT 30""",
    "d_block_rate": f"""{AUDIT}, r AS (SELECT {_window('us')} AS window_us, {_COUNTS} FROM audit GROUP BY 1)
        SELECT window_us, events, blocked, round(blocked / events, 6) AS block_rate, rate_limit_hits FROM r""",
    "d_allowlist": f"SELECT page_id, url, {_HOST} AS host FROM pages WHERE {_HOST} NOT LIKE '%.org'",
    "d_rbac": """SELECT event_id, c_mktsegment AS role, event_type AS resource FROM events LEFT JOIN customer ON c_custkey = user_id
        WHERE c_mktsegment IS NULL OR event_type NOT IN ('view', 'click', 'signup') OR (c_mktsegment = 'BUILDING' AND event_type = 'signup')""",
    "d_quota": f"""WITH u AS (SELECT event_id AS seq, user_id, count(*) OVER (PARTITION BY user_id, {US} // {c.DAY_US}
                               ORDER BY {US}, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)
        SELECT seq, used, c_custkey % 4 AS quota, coalesce(used > c_custkey % 4, false) AS over
        FROM u LEFT JOIN customer ON c_custkey = user_id""",
    "d_maintenance": f"""WITH ev AS (SELECT event_id, {US} AS us, event_type FROM events)
        SELECT e.event_id, e.us FROM ev e WHERE EXISTS (SELECT 1 FROM ev w WHERE w.event_type = 'purchase'
               AND e.us >= w.us AND e.us < w.us + 60000000)""",
    "d_forbidden_calls": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
                                     regexp_extract(url, '^([a-z]+)://', 1) AS tool, page_id % 2 = 0 AS known FROM pages)
        SELECT page_id, CASE WHEN tool = 'ftp' THEN 'dangerous_tool' WHEN tool = 'https' AND NOT known THEN 'unauthenticated'
                             WHEN starts_with(path, '/en/7') OR starts_with(path, '/en/8') THEN 'sensitive_path' END AS refusal FROM p""",
    "d_custom_policy": """SELECT doc_id, NOT n_chars > 3000 AS allowed,
        (n_chars > 3000)::BIGINT + (doc_id % 2 = 1)::BIGINT AS n_violations, (lang <> 'en')::BIGINT AS n_warnings FROM documents""",
}

_OWN = "t"
for _r in c.OWN_RULES:
    _OWN = f"regexp_replace({_OWN}, {literal(_r.pattern)}, {literal(c.OWN_TOKEN.replace('{}', _r.category))}, 'g')"
_N_OWN = _count([_hit("t", r) for r in c.OWN_RULES])
D["d_custom_rules"] = f"""WITH {PLANTED} SELECT doc_id, ({_N_OWN}) = 0 AND NOT {_LONG} AS valid, {_OWN} AS sanitized,
    {_N_OWN} + ({_LONG})::BIGINT AS n_violations FROM planted"""
D["d_rotation"] = f"{AUDIT} {_EVENTS} WHERE us >= epoch_us(TIMESTAMP '{c.ROTATE_BEFORE}')"

D["d_handler"] = """WITH l AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'INPUT_BLOCKED' WHEN 'view' THEN 'RATE_LIMIT_EXCEEDED'
                                ELSE 'INPUT_PROCESSED' END AS event_type FROM events)
    SELECT 'log' AS sink, * FROM l UNION ALL SELECT 'alerts', * FROM l WHERE event_type <> 'INPUT_PROCESSED'"""

_PATTERNS = [*c.CHANGE_PATTERNS, *(p.pattern for p in POLICIES)]
_FOUND = " UNION ALL ".join(f"SELECT seq, {literal(p)} AS pattern FROM req WHERE regexp_matches(text, {literal(p)})"
                            for p in _PATTERNS if p not in _BAD)
P["p_version_hits"] = f"""
    WITH {REQUESTS}, {CHANGES.replace("'p' || user_id", "'p' || (event_id % 7)")}, steps AS (
        SELECT seq AS since, lead(seq) OVER (PARTITION BY name ORDER BY seq) AS until, name, op, pattern, action
        FROM (SELECT * FROM defaults UNION ALL SELECT * FROM effect)),
    found AS ({_FOUND})
    SELECT f.seq, s.name AS policy, s.action FROM found f JOIN steps s
    ON s.op = 'add' AND f.pattern = s.pattern AND f.seq > s.since AND (s.until IS NULL OR f.seq <= s.until)"""

ORACLES: dict[str, str] = {**V, **F, **P, **R, **G, **A, **C, **S, **D}
