"""SQL twins of queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from sluice.functions.render import RULE
from sluice.functions.text import TRUNCATED
from sluice.operators.decide import LISTS
from sluice.operators.parse import ARABIC
from sluice.operators.review import FENCE
from sluice.sources.lexicon import PROSE

BLANK = r"[\p{Z}\s\x{0b}\x{1c}-\x{1f}\x{85}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def paragraphs(x: str) -> str:
    lines = f"array_to_string(list_transform(string_split(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: {strip('l')}), chr(10))"
    two = f"regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    one = f"replace(replace(replace({two}, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10))"
    return strip(f"regexp_replace({one}, '[ \\t]{{2,}}', ' ', 'g')")


NORMALIZED = f"SELECT doc_id, sha256({norm('text')}) AS norm_sha256, length({norm('text')})::BIGINT AS n_chars FROM documents"

LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
#: doc_id, title and body of documents.
JOBS = f"""jobs AS (
  SELECT doc_id, text, coalesce(list_filter(list_transform(lines, lambda l: {strip('l')}), lambda l: l <> '')[1], '') AS title,
    coalesce(array_to_string(lines[pos + 1:], chr(10)), '') AS body
  FROM (SELECT *, list_position(list_transform(lines, lambda l: {strip('l')} <> ''), true) AS pos FROM (SELECT doc_id, coalesce(text, '') AS text, {LINES} AS lines FROM documents))
)"""
PARSED = f"""WITH {JOBS} SELECT doc_id, title, sha256({paragraphs('body')}) AS description_sha256, '' AS budget, regexp_extract(text, 'https?://[^\\s]+') AS url FROM jobs"""

#: documents in the labelled layout, as the query parse_labelled writes them; without its label the title is the first line.
_FIRST = strip("string_split(coalesce(text, ''), chr(10))[1]")
LABELLED = f"""SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN 'Post ' || doc_id WHEN {_FIRST} = '' THEN '{ARABIC.description}:' ELSE '{ARABIC.description}: ' || regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '{BLANK}+$', '') END AS title,
  sha256({paragraphs("coalesce(text, '')")}) AS description_sha256, CASE WHEN doc_id % 4 = 2 THEN '' ELSE doc_id::VARCHAR END AS budget FROM documents"""

JOB_UUID = """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS job_uuid
FROM (SELECT doc_id, sha1(unhex('6f6e646573704a6f62737570706f7274') || encode(source || ':' || doc_id)) AS h FROM documents)"""


LEGACY = JOB_UUID.replace("source || ':'", "'One' || ':'").replace("AS job_uuid", "AS legacy_job_uuid").replace("SELECT doc_id, substr", "SELECT doc_id, CASE WHEN NOT contains(source, 'src1') THEN NULL ELSE substr").replace("substr(h, 21, 12) AS", "substr(h, 21, 12) END AS").replace("SELECT doc_id, sha1", "SELECT doc_id, source, sha1")


def _ordered(profile: str, polarity: str, tier: str) -> list[tuple[str, int, str]]:
    words = [(k, w, g) for g, kw in PROSE[profile].get(polarity, {}).get(tier, {}).items() for k, w in kw.items()]
    return sorted(words, key=lambda x: -len(x[0]))


def _masked(profile: str, polarity: str, tier: str) -> str:
    """One row for each document and keyword that is left when longer ones are blanked first."""
    words = _ordered(profile, polarity, tier)
    t, hits = "t", []
    for k, w, g in words:
        two = "' " + k.replace(" ", "  ") + " '"
        hits.append(f"CASE WHEN contains({t}, {two}) THEN {{'norm': '{k}', 'weight': {w}, 'grp': '{g}'}} END")
        t = f"replace({t}, {two}, ' # ')"
    return f"SELECT doc_id, '{profile}' AS profile_id, '{polarity}' AS polarity, '{tier}' AS tier, unnest([{', '.join(hits)}]) AS h FROM spaced"


SPACED = f"""spaced AS (
  SELECT doc_id, ' ' || replace(n, ' ', '  ') || ' ' AS t, ' ' || tn || ' ' AS title, ' ' || n || ' ' AS n
  FROM (SELECT doc_id, {norm("title || chr(10) || " + paragraphs("body"))} AS n, {norm('title')} AS tn FROM jobs)
)"""
HITS = f"""{JOBS}, {SPACED}, hits AS (
  SELECT doc_id, profile_id, polarity, tier, h.norm AS norm, h.weight::INTEGER AS weight FROM (
    {' UNION ALL '.join(_masked(p, pol, tier) for p in PROSE for pol, tier in LISTS)}) WHERE h IS NOT NULL
)"""
TIER_HITS = f"WITH {HITS} SELECT * FROM hits"


LONG_KEYWORDS = f"""WITH {JOBS}, {SPACED}, keywords AS (
  SELECT DISTINCT array_to_string(w[:item_id % 8 + 1], ' ') AS norm, least(item_id % 8 + 1, len(w))::BIGINT AS n_tokens FROM (SELECT item_id, string_split({norm("text")}, ' ') AS w FROM benchmark)
)
SELECT doc_id, norm, n_tokens, contains(title, ' ' || norm || ' ') AS in_title FROM spaced JOIN keywords ON norm <> '' AND contains(n, ' ' || norm || ' ')"""


def _any(column: str, profile: str, polarity: str, tier: str) -> str:
    return "(" + (" OR ".join(f"contains({column}, ' {k} ')" for k, _, _ in _ordered(profile, polarity, tier)) or "false") + ")"


FLAGS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS profile_ord, '{p}' AS profile_id, {_any('title', p, 'positive', 'core')} AS tp, {_any('title', p, 'negative', 'core')} AS tn, {_any('n', p, 'hard_reject', 'hard')} AS hard FROM spaced" for i, p in enumerate(PROSE)
)
RESULTS = f"""{HITS}, flags AS ({FLAGS}), ev AS (
  SELECT f.doc_id, f.profile_ord, f.profile_id, f.tp, f.tn, f.hard,
    count(*) FILTER (WHERE polarity = 'positive' AND tier = 'core')::INTEGER AS cp, count(*) FILTER (WHERE polarity = 'negative' AND tier = 'core')::INTEGER AS cn,
    coalesce(sum(weight) FILTER (WHERE polarity = 'positive' AND tier = 'supporting'), 0)::INTEGER AS sp, coalesce(sum(weight) FILTER (WHERE polarity = 'negative' AND tier = 'supporting'), 0)::INTEGER AS sn,
    count(*) FILTER (WHERE polarity = 'positive') > 0 AS matched
  FROM flags f LEFT JOIN hits h ON h.doc_id = f.doc_id AND h.profile_id = f.profile_id GROUP BY ALL
), ruled AS (
  SELECT *, CASE WHEN hard THEN 'hard_reject_keyword'
    WHEN tp AND NOT tn AND cn > 0 THEN 'title_positive_but_body_core_negative'
    WHEN tp AND NOT tn AND sn >= 10 THEN 'title_core_positive_but_heavy_supporting_negative'
    WHEN tp AND NOT tn THEN 'title_core_positive'
    WHEN tn AND NOT tp AND cp = 0 THEN 'title_core_negative_no_body_positive'
    WHEN cp > 0 AND cn > 0 THEN 'mixed_core_signals'
    WHEN cn > 0 THEN 'core_negative_no_core_positive'
    WHEN cp = 1 AND sp < 5 THEN 'lone_core_positive_insufficient_support'
    WHEN cp > 0 AND sn >= 14 THEN 'core_positive_but_heavy_supporting_negative'
    WHEN cp > 0 THEN 'core_positive_clean'
    WHEN sp >= 12 THEN 'supporting_positive_only' ELSE 'insufficient_signal' END AS reason FROM ev
), results AS (
  SELECT *, CASE WHEN reason IN ('title_core_positive', 'core_positive_clean') THEN 'direct'
    WHEN reason IN ('hard_reject_keyword', 'title_core_negative_no_body_positive', 'core_negative_no_core_positive', 'insufficient_signal') THEN 'reject' ELSE 'review' END AS decision FROM ruled
)"""
CLASSIFIED = f"""WITH {RESULTS} SELECT doc_id, profile_id, decision, reason, cp AS core_positive_count, cn AS core_negative_count, sp AS supporting_positive_weight, sn AS supporting_negative_weight,
  tp AS title_core_positive, tn AS title_core_negative, hard AS hard_reject, matched FROM results"""
DECISION_COUNTS = f"WITH {RESULTS} SELECT profile_id, decision, reason, count(*) AS n FROM results GROUP BY ALL"
PICKED = f"""{RESULTS}, rolled AS (
  SELECT doc_id, count(*) FILTER (WHERE decision = 'direct')::INTEGER AS n_direct, count(*) FILTER (WHERE decision = 'review')::INTEGER AS n_review,
    coalesce(string_agg(profile_id, ', ' ORDER BY profile_ord) FILTER (WHERE decision <> 'reject'), '') AS candidates,
    coalesce(string_agg(profile_id, ', ' ORDER BY profile_ord) FILTER (WHERE decision = 'review'), '') AS review_ids, min(profile_id) FILTER (WHERE decision = 'direct') AS direct_id,
    arg_min(profile_id, profile_ord) FILTER (WHERE decision <> 'reject') AS first_candidate FROM results GROUP BY doc_id
), picked AS (
  SELECT *, CASE WHEN n_direct = 1 AND n_review = 0 THEN direct_id END AS selected, NOT (n_direct = 1 AND n_review = 0) AND (n_review > 0 OR n_direct > 1) AS needs_arbitration FROM rolled
)"""
SELECTED = f"""WITH {PICKED} SELECT doc_id, n_direct, n_review, candidates, review_ids, selected, CASE WHEN n_review = 1 THEN review_ids END AS single_review, n_direct > 0 AS has_direct, needs_arbitration FROM picked"""
DECIDED = f"""{PICKED}, decided AS (
  SELECT p.doc_id, CASE WHEN selected IS NOT NULL THEN 'Accepted' WHEN candidates = '' THEN 'Rejected' END AS final_decision,
    CASE WHEN selected IS NOT NULL THEN r.reason WHEN candidates <> '' THEN NULL WHEN r.hard THEN 'Hard Reject' WHEN NOT r.matched THEN 'No Matching Keywords' ELSE r.reason END AS decision_reason,
    selected AS category_id, CASE WHEN selected IS NOT NULL THEN 'keyword_direct' END AS selection_method, CASE WHEN selected IS NOT NULL THEN 'Pending' END AS notification_status,
    candidates, needs_arbitration, r.reason AS filter_reason, first_candidate
  FROM picked p JOIN results r ON r.doc_id = p.doc_id AND r.profile_id = coalesce(p.selected, p.first_candidate, '{next(iter(PROSE))}')
)"""
FINAL = f"WITH {DECIDED} SELECT * EXCLUDE (first_candidate) FROM decided"
FINAL_COUNTS = f"WITH {DECIDED} SELECT final_decision, decision_reason, count(*) AS n FROM decided GROUP BY ALL"
REVIEWED = f"""WITH {DECIDED}, said AS (SELECT *, needs_arbitration AND doc_id % 3 = 0 AS yes FROM decided)
SELECT doc_id, CASE WHEN yes THEN 'Accepted' WHEN needs_arbitration THEN 'Rejected' ELSE final_decision END AS final_decision,
  CASE WHEN needs_arbitration AND doc_id % 3 < 2 THEN 'said so' WHEN needs_arbitration THEN 'LLM Error' ELSE decision_reason END AS decision_reason,
  CASE WHEN yes THEN first_candidate ELSE category_id END AS category_id, CASE WHEN yes THEN 'llm' ELSE selection_method END AS selection_method,
  CASE WHEN yes THEN 'Pending' ELSE notification_status END AS notification_status, candidates, yes AS reviewed FROM said"""

CLAIMS = """WITH RECURSIVE c AS (SELECT user_id AS project_id, event_type AS job, ts, event_id FROM events),
owner AS (
  SELECT project_id, min({'ts': ts, 'e': event_id, 'job': job}) AS o FROM c GROUP BY 1
  UNION ALL
  SELECT project_id, n FROM (SELECT c.project_id, min({'ts': c.ts, 'e': c.event_id, 'job': c.job}) AS n FROM c JOIN owner w ON w.project_id = c.project_id AND c.ts > w.o.ts + INTERVAL 5 DAY GROUP BY 1, w.o)
)
SELECT event_id, c.project_id, o.job AS owner, o.ts AS claimed_at, o.job = c.job AS claimed FROM c ASOF JOIN (SELECT project_id, o, o.ts AS at FROM owner) w ON c.project_id = w.project_id AND c.ts >= w.at"""

RESUME = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'resume' WHEN 1 THEN 'mark_pending' WHEN 2 THEN 'skip' WHEN 3 THEN 'reprocess' WHEN 4 THEN 'skip' ELSE 'process' END AS action FROM documents"""

BACKLOG = """WITH w AS (SELECT user_id, min(event_id) AS last_id FROM events WHERE user_id % 3 <> 0 GROUP BY 1)
SELECT user_id AS chat_id, event_id AS msg_id, k AS backlog_rank FROM (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS k FROM events e JOIN w ON w.user_id = e.user_id AND e.event_id > w.last_id) WHERE k <= 20"""

FEED = """feed AS (SELECT event_type || '-' || (user_id % 20) AS poll_source, event_id, row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY event_id DESC, event_id::VARCHAR) AS k FROM events),
page AS (SELECT poll_source, event_id, k, ((k - 1) // 7 + 1)::INTEGER AS page FROM feed WHERE k <= 70)"""
PAGED = f"WITH {FEED} SELECT poll_source, event_id::VARCHAR AS uid, page FROM page"
CATCHUP = f"""WITH {FEED}, seen AS (SELECT poll_source, event_id FROM feed WHERE event_id % 37 = 0 AND poll_source NOT LIKE 'view%'),
stop AS (SELECT poll_source, min(page) AS stop FROM page JOIN seen USING (poll_source, event_id) GROUP BY 1)
SELECT poll_source, event_id::VARCHAR AS uid, page, row_number() OVER (PARTITION BY poll_source ORDER BY k DESC) AS arrival FROM page LEFT JOIN stop USING (poll_source)
WHERE page <= least(coalesce(stop, 10), 10) AND (poll_source, event_id) NOT IN (SELECT poll_source, event_id FROM seen) AND poll_source IN (SELECT poll_source FROM seen)"""

#: Two polls of the same pages: between them every third project found was processed.
CAUGHT_UP = f"""WITH {FEED}, seeds AS (SELECT poll_source, event_id FROM page WHERE event_id % 5 = 0 AND poll_source NOT LIKE 'view%'),
stop AS (SELECT poll_source, min(page) AS stop FROM page JOIN seeds USING (poll_source, event_id) GROUP BY 1),
new AS (SELECT poll_source, event_id, page, k, 2 AS seq FROM page JOIN stop USING (poll_source) WHERE page <= stop AND (poll_source, event_id) NOT IN (SELECT * FROM seeds)),
seen AS (SELECT * FROM seeds UNION ALL SELECT poll_source, event_id FROM new WHERE event_id % 3 = 0),
again AS (SELECT poll_source, min(page) AS stop FROM page JOIN seen USING (poll_source, event_id) GROUP BY 1),
every AS (SELECT * FROM new UNION ALL SELECT poll_source, event_id, page, k, 1000 FROM page JOIN again USING (poll_source) WHERE page <= stop AND (poll_source, event_id) NOT IN (SELECT * FROM seen))
SELECT poll_source, seq::BIGINT AS seq, event_id::VARCHAR AS uid, row_number() OVER (PARTITION BY poll_source, seq ORDER BY k DESC) AS arrival FROM every"""

QUEUE = """queue AS (SELECT o_orderkey AS seq, o_custkey AS user_id, CASE WHEN o_orderstatus = 'O' THEN 'Pending' WHEN o_orderkey % 3 = 0 THEN 'Sending' WHEN o_orderstatus = 'F' THEN 'Failed' ELSE 'Sent' END AS status,
  (o_orderkey % 6)::INTEGER AS attempts, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS next_at FROM orders)"""
CLAIM_BATCH = f"""WITH {QUEUE} SELECT seq AS notification_id, user_id, 'Sending' AS status, attempts + 1 AS attempts FROM queue
WHERE status IN ('Pending', 'Failed') AND attempts < 5 AND (next_at IS NULL OR next_at <= TIMESTAMP '1998-01-01') AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ORDER BY seq LIMIT 20"""
OUTCOMES = f"""WITH {QUEUE}, r AS (SELECT *, status = 'Sending' AND seq % 5 < 4 AS known, seq % 5 AS k FROM queue)
SELECT seq AS notification_id, CASE WHEN known AND k = 0 THEN 'Sent' WHEN known THEN 'Failed' ELSE status END AS status, attempts, CASE WHEN known AND k > 0 THEN 'refused' ELSE '' END AS last_error,
  CASE WHEN NOT known THEN next_at WHEN k = 0 THEN NULL WHEN k = 1 THEN TIMESTAMP '1998-01-01 00:00:30' WHEN k = 2 OR attempts >= 5 THEN next_at ELSE TIMESTAMP '1998-01-01' + to_seconds(least(300, 5 * 2 ** attempts)) END AS next_attempt_at,
  known AND k = 2 AS deactivate FROM r"""

RESET = f"""WITH {QUEUE} SELECT seq AS notification_id, CASE WHEN status = 'Sending' THEN 'Pending' ELSE status END AS status, attempts, CASE WHEN status = 'Sending' THEN TIMESTAMP '1998-01-01' ELSE next_at END AS next_attempt_at FROM queue"""

GUARD = """log AS (SELECT doc_id, doc_id AS seq, CASE WHEN toxic = 1 THEN 'do_not_notify' WHEN quality = 1 THEN 'notify' ELSE 'error' END AS g FROM labels),
every AS (SELECT * FROM log UNION ALL SELECT doc_id, seq + 1000000000, CASE WHEN g = 'error' THEN 'notify' ELSE 'error' END FROM log WHERE doc_id % 3 = 0),
latest AS (SELECT doc_id, arg_max(g, seq) AS g FROM every GROUP BY 1)"""
LATEST_GUARD = f"""WITH {GUARD} SELECT d.doc_id AS job_uuid, g AS guard_decision, CASE WHEN d.doc_id % 11 = 0 OR g = 'notify' THEN 'allow' WHEN g = 'do_not_notify' THEN 'deny' ELSE 'evaluate' END AS gate FROM documents d LEFT JOIN latest l ON l.doc_id = d.doc_id"""
ADVANCE = f"""WITH {GUARD}, d AS (SELECT doc_id, ['', 'Pending', 'Telegram: Failed', 'Complete', 'Telegram: Sent'][doc_id % 5 + 1] AS s FROM documents)
SELECT d.doc_id AS job_uuid, s AS status_before, CASE WHEN s = 'Telegram: Sent' THEN 'Complete' WHEN d.doc_id % 7 = 0 THEN s WHEN d.doc_id % 2 = 0 THEN 'Complete' WHEN g = 'do_not_notify' THEN 'Suppressed' ELSE 'Telegram: Failed' END AS notification_status
FROM d LEFT JOIN latest l ON l.doc_id = d.doc_id WHERE s NOT IN ('', 'Complete')"""

ARBITRATIONS = """SELECT event_id, CASE WHEN ok THEN CASE WHEN k = 5 THEN 'none' ELSE event_type END END AS selected_category, CASE WHEN ok THEN round(value, 6) END AS confidence
FROM (SELECT *, event_id % 8 AS k, (event_id % 8 = 5 OR event_type IN ('view', 'click', 'signup')) AND event_id % 8 IN (0, 5, 7) AND value BETWEEN 0 AND 100 AS ok FROM events)"""

FIRST_VALID = """WITH f AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'signup') AS first FROM events GROUP BY 1)
SELECT e.user_id AS job_uuid, CASE WHEN first IS NOT NULL THEN 'signup' END AS answer, coalesce(string_agg(event_type, ' | ' ORDER BY event_id) FILTER (WHERE event_type <> 'signup' AND (first IS NULL OR event_id < first)), '') AS errors FROM events e JOIN f USING (user_id) GROUP BY e.user_id, first"""


def _escaped(x: str) -> str:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{c}', '{name}')"
    return x


_CUT = f"CASE WHEN length(d) > 3000 THEN {strip('left(d, 2997)')} || '...' ELSE d END"
_RULE = RULE
SUBSCRIBER = f"""WITH {JOBS}, m AS (SELECT doc_id, {_escaped('title')} AS title, {paragraphs('body')} AS d FROM jobs),
s AS (SELECT m.doc_id, '🚀 <b>New Text &amp; more Opportunity</b>' || chr(10) || chr(10) || '📄 <b>' || title || '</b>' || chr(10) || '🏢 <b>Platform</b>' || chr(10) || CASE WHEN contains(source, 'src1') THEN 'One' ELSE source END
  || CASE WHEN d <> '' THEN chr(10) || chr(10) || '{_RULE}' || chr(10) || chr(10) || '📋 <b>Description</b>' || chr(10) || chr(10) || {_escaped(_CUT)} ELSE '' END
  || chr(10) || chr(10) || '{_RULE}' || chr(10) || '🏷 <b>Tags</b>' || chr(10) || '#' || lang || ' #twowords' AS t, FROM m JOIN documents USING (doc_id))
SELECT doc_id, sha256(CASE WHEN length(t) > 4000 THEN concat(u, repeat('</b>', greatest(((length(u) - length(replace(u, '<b>', ''))) // 3 - (length(u) - length(replace(u, '</b>', ''))) // 4)::INTEGER, 0)), '...') ELSE t END) AS message_sha256
FROM (SELECT *, CASE WHEN strpos(reverse(w), '<') > 0 AND (strpos(reverse(w), '>') = 0 OR strpos(reverse(w), '<') < strpos(reverse(w), '>')) THEN {strip("left(w, length(w) - strpos(reverse(w), '<'))")} ELSE w END AS u FROM (SELECT *, {strip('left(t, 3997)')} AS w FROM s))"""

REPRESENTATIVE = f"""WITH {PICKED} SELECT p.doc_id, r.profile_id, r.decision, r.reason FROM picked p JOIN results r ON r.doc_id = p.doc_id AND r.profile_id = coalesce(p.selected, p.first_candidate, '{next(iter(PROSE))}')"""


def _hard(profile: str) -> str:
    words = sorted((k for group in PROSE[profile]["hard_reject"]["hard"].values() for k in group), key=lambda k: (-len(k), k))
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(n, ' {k} ') THEN '{k}' END" for k in words) + "], lambda x: x IS NOT NULL), ', ')"


HARD = f"""WITH {JOBS}, {SPACED} SELECT * FROM ({' UNION ALL '.join(f"SELECT doc_id, '{p}' AS profile_id, {_hard(p)} AS hard_reject_matches FROM spaced" for p in PROSE)}) WHERE hard_reject_matches <> ''"""

GUARD_RESULTS = """SELECT doc_id AS job_uuid, CASE WHEN doc_id % 5 = 0 OR quality + toxic = 0 THEN 'error' WHEN toxic = 1 THEN 'do_not_notify' ELSE 'notify' END AS guard_decision FROM labels"""

REVIEWS = """SELECT event_id, CASE WHEN ok THEN CASE WHEN value > 10 THEN 'accept' ELSE 'reject' END END AS decision, CASE WHEN ok THEN round(value, 6) END AS confidence, CASE WHEN ok THEN event_type END AS skills
FROM (SELECT *, event_id % 6 NOT IN (1, 2, 3) AND value BETWEEN 0 AND 100 AS ok FROM events)"""

INCOMPLETE = """SELECT o_orderkey AS job_uuid FROM orders WHERE o_orderstatus NOT IN ('F') AND o_orderpriority NOT LIKE '5%' AND o_orderpriority NOT LIKE '1%'"""


def _lf(x: str) -> str:
    """A text as SQL, with chr(10) for its line feeds."""
    return " || ".join("chr(10)" if part == "\n" else "'" + part.replace("'", "''") + "'" for part in re.split("(\n)", x) if part)


_FENCED = f"{_lf(FENCE)} || x || {_lf(chr(10) + '</post>')}"
_TEXT = f"CASE WHEN length(text) > 3500 THEN left(text, 3500) || {_lf(TRUNCATED)} ELSE text END"
#: Ranked hits of RESULTS by tier, with their groups.
_LISTED = f"""{RESULTS}, rank AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{pol}', '{t}', '{k}', {n})" for p in PROSE for pol, t in LISTS for n, (k, _, _) in enumerate(_ordered(p, pol, t)))}) AS r(profile_id, polarity, tier, norm, n)),
grouped AS (SELECT h.doc_id, h.profile_id, h.polarity, h.tier, h.norm, h.weight, g.grp, r.n FROM hits h JOIN rank r USING (profile_id, polarity, tier, norm)
  JOIN (VALUES {', '.join(f"('{p}', '{pol}', '{t}', '{k}', '{g}')" for p in PROSE for pol, t in LISTS for k, _, g in _ordered(p, pol, t))}) AS g(profile_id, polarity, tier, norm, grp) USING (profile_id, polarity, tier, norm)),
lists AS (SELECT r.*,
  {', '.join(f"coalesce((SELECT string_agg(norm || ' (' || grp || ', weight ' || weight || ')', ', ' ORDER BY n) FROM grouped g WHERE g.doc_id = r.doc_id AND g.profile_id = r.profile_id AND polarity = '{pol}' AND tier = '{t}'), '(none)') AS {pol}_{t}" for pol, t in LISTS)},
  {', '.join(f"coalesce((SELECT string_agg(grp, ', ' ORDER BY grp) FROM (SELECT DISTINCT grp FROM grouped g WHERE g.doc_id = r.doc_id AND g.profile_id = r.profile_id AND polarity = '{pol}')), '') AS {pol}_groups" for pol in ('positive', 'negative'))}
  FROM results r)"""
REVIEW_PROMPT = f"""WITH {_LISTED}, asked AS (
  SELECT doc_id, profile_id, 'Decision: review' || chr(10) || 'Reason: ' || reason || chr(10) || 'Positive groups: [' || positive_groups || ']' || chr(10) || 'Negative groups: [' || negative_groups || ']' || chr(10)
    || 'Positive core: ' || positive_core || chr(10) || 'Positive supporting: ' || positive_supporting || chr(10) || 'Negative core: ' || negative_core || chr(10) || 'Negative supporting: ' || negative_supporting || chr(10)
    || 'Supporting weight: ' || sp || ' : ' || sn || chr(10) || chr(10) || {_FENCED} AS p
  FROM lists JOIN (SELECT doc_id, {_TEXT} AS x FROM documents) USING (doc_id) WHERE decision = 'review')
SELECT doc_id, profile_id, length(p)::BIGINT AS n_chars, sha256(p) AS prompt_sha256 FROM asked"""
_FORM = 'Answer with one JSON object: {"selected_category": an id from the list or "none", "confidence": 0 to 100, "reason": text}'
ARBITRATION_PROMPT = f"""WITH {_LISTED}, block AS (
  SELECT doc_id, string_agg('CATEGORY ID: ' || profile_id || chr(10) || 'NAME: ' || upper(left(profile_id, 1)) || substr(profile_id, 2) || chr(10) || 'DESCRIPTION: Prose in ' || profile_id || chr(10) || 'SCOPE: Texts mostly in ' || profile_id
    || chr(10) || 'REASON: ' || reason || chr(10) || 'POSITIVE: ' || positive_groups || chr(10) || 'NEGATIVE: ' || negative_groups, chr(10) || chr(10) ORDER BY profile_ord) AS b FROM lists WHERE decision <> 'reject' GROUP BY doc_id
), asked AS (
  SELECT doc_id, 'Choose the one category that fits this post best, or none.' || chr(10) || chr(10) || b || chr(10) || chr(10) || {_FENCED} || chr(10) || chr(10) || '{_FORM}' AS p FROM block JOIN (SELECT doc_id, {_TEXT} AS x FROM documents) USING (doc_id))
SELECT doc_id, length(p)::BIGINT AS n_chars, sha256(p) AS prompt_sha256 FROM asked"""

_GUARD_HEAD = 'Should this post be passed on? Answer with one JSON object: {"decision": "notify" or "do_not_notify"}\n\n'
GUARD_PROMPT = f"""WITH {JOBS}, p AS (SELECT doc_id, {_lf(_GUARD_HEAD)} || {_FENCED} AS p FROM (SELECT doc_id, title || chr(10) || chr(10) || {paragraphs('body')} AS x FROM jobs))
SELECT doc_id, length(p)::BIGINT AS n_chars, sha256(p) AS prompt_sha256 FROM p"""


def _clipped(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN {strip(f'left({x}, {n - 3})')} || '...' ELSE {x} END"


_WHOLE = SUBSCRIBER[SUBSCRIBER.index("SELECT doc_id, sha256(") :].replace("SELECT doc_id, sha256(", "SELECT doc_id, ", 1).replace("ELSE t END) AS message_sha256", "ELSE t END AS m", 1)
PRIVATE = f"""WITH {JOBS}, d AS (SELECT doc_id, title, {paragraphs('body')} AS d, text AS r FROM jobs),
s AS (SELECT d.doc_id, '🚀 <b>New Freelance Opportunity</b>' || chr(10) || chr(10) || CASE WHEN d.doc_id % 2 = 0 THEN '🧠 <b>AI Recommendation</b>' ELSE '⚡ <b>Direct Match</b>' END || chr(10) || chr(10) || '🏢 <b>Platform</b>' || chr(10) || source
  || chr(10) || chr(10) || '📄 <b>Project</b>' || chr(10) || {_escaped('title')}
  || CASE WHEN d <> '' THEN chr(10) || chr(10) || '{RULE}' || chr(10) || chr(10) || '📋 <b>Description</b>' || chr(10) || chr(10) || {_escaped(_clipped('d', 3000))} ELSE '' END
  || chr(10) || chr(10) || '🏷 <b>Categories</b>' || chr(10) || lang
  || CASE WHEN r <> '' THEN chr(10) || chr(10) || '{RULE}' || chr(10) || chr(10) || '💡 <b>Reason</b>' || chr(10) || chr(10) || {_escaped(_clipped('r', 1200))} ELSE '' END AS t FROM d JOIN documents USING (doc_id)),
m AS ({_WHOLE}) SELECT doc_id, length(m)::BIGINT AS n_chars, sha256(m) AS message_sha256 FROM m"""

#: posts as the query stream_claims lands them, in four batches; a post's time is never before what came in earlier batches, less a day.
STREAM_CLAIMS = f"""WITH RECURSIVE posts AS (
  SELECT doc_id, doc_id % 4 AS batch, doc_id // 3 AS project, timestamp '2024-01-01' + to_hours(doc_id::INTEGER) - CASE WHEN doc_id % 7 = 0 THEN interval 40 day ELSE interval 0 day END AS ts FROM documents
), marks AS (
  SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - interval 1 day AS mark FROM (SELECT batch, max(ts) AS latest FROM posts GROUP BY batch)
), arrived AS (
  SELECT doc_id, project, greatest(ts, coalesce(mark, ts)) AS at_time, row_number() OVER (PARTITION BY project ORDER BY batch) AS k FROM posts JOIN marks USING (batch)
), folded AS (
  SELECT project, k, doc_id, doc_id AS owner, at_time AS since FROM arrived WHERE k = 1
  UNION ALL SELECT a.project, a.k, a.doc_id, CASE WHEN a.at_time > f.since + interval 5 day THEN a.doc_id ELSE f.owner END, CASE WHEN a.at_time > f.since + interval 5 day THEN a.at_time ELSE f.since END
  FROM folded f JOIN arrived a ON a.project = f.project AND a.k = f.k + 1
)
SELECT d.doc_id, CASE WHEN f.owner = f.doc_id THEN d.final_decision ELSE 'Rejected' END AS final_decision, CASE WHEN f.owner = f.doc_id THEN d.decision_reason ELSE 'Duplicate project from another source' END AS decision_reason
FROM ({FINAL}) d JOIN folded f ON f.doc_id = d.doc_id"""

#: the queue that the query delivery_stream ends with: sends 1 to 5 are 0, 11, 32, 73 and 154 seconds after the first, each ends a second later.
DELIVERED = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS u, o_orderkey % 7 AS fails, timestamp '2024-01-01' + to_seconds(o_orderkey) AS t FROM orders),
a AS (SELECT *, least(fails + 1, 5) AS attempts, t + to_seconds([0, 11, 32, 73, 154][least(fails + 1, 5)]) AS last FROM o)
SELECT u AS user_id, k AS notification_id, CASE WHEN fails < 5 THEN 'Sent' ELSE 'Failed' END AS status, attempts::INTEGER AS attempts, CASE WHEN fails < 5 THEN '' ELSE 'no' END AS last_error,
  CASE WHEN fails >= 5 THEN last END AS next_attempt_at, last + interval 1 second AS updated_at FROM a"""

#: what the query retry_sweep ends with: a send ends every 400 seconds, sweeps are at multiples of 300.
SWEPT = """WITH d AS (SELECT doc_id, doc_id % 4 AS fails, 1704067200 + 7 * doc_id AS t FROM documents),
e AS (SELECT *, fails > 0 AND doc_id % 5 = 0 AS held, t + 400 * CASE WHEN fails > 0 AND doc_id % 5 = 0 THEN 1 ELSE fails + 1 END AS last FROM d)
SELECT doc_id, CASE WHEN held THEN 'Suppressed' ELSE 'Complete' END AS status, (1 + last // 300 - t // 300)::BIGINT AS sends FROM e"""

_LISTED = ", ".join(f"('{p}', '{pol}', '{tier}', '{k}', {o}, '{g}')" for p in PROSE for pol, tier in LISTS for o, (k, _, g) in enumerate(_ordered(p, pol, tier)))
#: the hits of each post and profile as the audit tables name them, in the order of the lexicon.
EVIDENCE = f"""WITH {HITS}, listed (profile_id, polarity, tier, norm, ord, grp) AS (VALUES {_LISTED}), said AS (
  SELECT doc_id, profile_id, polarity || '_' || tier AS list, string_agg(norm || '(' || weight || '/' || grp || ')', ', ' ORDER BY ord) AS text FROM hits JOIN listed USING (profile_id, polarity, tier, norm) GROUP BY ALL
), every AS (SELECT doc_id, p.profile_id FROM documents, (SELECT DISTINCT profile_id FROM listed) p)
SELECT e.doc_id, e.profile_id, {", ".join(f"coalesce(max(text) FILTER (WHERE list = '{p}_{t}'), '') AS {p}_{t}" for p, t in LISTS)} FROM every e LEFT JOIN said s USING (doc_id, profile_id) GROUP BY ALL"""
POLICIES = f"""WITH {RESULTS}, told (profile_id, name, scope, policy) AS (VALUES {", ".join(f"('{p}', '{p.title()}', 'Texts mostly in {p}', {repr('Wants ' + p) if p != 'romance' else 'NULL'})" for p in PROSE)})
SELECT doc_id, 'Judge by what the post wants delivered.' || chr(10) || chr(10) || string_agg('CATEGORY: ' || name || ' (' || profile_id || ')' || chr(10) || coalesce(policy, ''), chr(10) || chr(10) ORDER BY profile_ord) AS policy,
  bool_and(policy IS NOT NULL) AS complete FROM results JOIN told USING (profile_id) WHERE decision <> 'reject' GROUP BY doc_id"""
