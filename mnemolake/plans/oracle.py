"""The registered queries in DuckDB SQL: written against the definitions, not derived from the Spark code."""

from __future__ import annotations

from ..config import PROFILE_KEYS, Settings, Tier, profile_for
from ..functions import guards, rules
from ..functions.text import _ACCENTED, _PLAIN, _STEP2, _STEP3, _STEP4, STOPWORDS
from ..operators.assembly import SECTIONS

AS_OF = "TIMESTAMP '2025-07-01'"
_P = profile_for(Settings(stem=False), Tier.FULL)
_WS = r"[ \t\n\x0B\f\r]"


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


def tokens_of(c: str) -> str:
    return f"greatest(1, length({c}) // 4)"


def norm_key(c: str) -> str:
    return f"regexp_replace(replace(lower({strip(c)}), ' ', '_'), '[^a-z0-9_]', '', 'g')"


def canonical(c: str) -> str:
    return rf"regexp_replace({squeeze(f'lower({c})')}, '\A(the|a|an) ', '')"


def terms_of(c: str) -> str:
    raw = f"regexp_extract_all(lower({c}), '[a-z0-9]{{2,}}')"
    return f"(SELECT CASE WHEN len(k) > 0 THEN k ELSE r END FROM (SELECT r, [t FOR t IN r IF t NOT IN {_list(STOPWORDS)}] AS k FROM (SELECT {_distinct(raw)} AS r)))"


def _distinct(raw: str) -> str:
    """A list without repeats, in first-seen order."""
    return f"(SELECT coalesce(list(t ORDER BY p), []) FROM (SELECT t, min(p) AS p FROM (SELECT unnest({raw}) AS t, generate_subscripts({raw}, 1) AS p) GROUP BY t))"


def index_of(c: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({c}, '')), '{_ACCENTED}', '{_PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def days(later: str, earlier: str) -> str:
    return f"coalesce(greatest(0.0, date_diff('microsecond', {earlier}, {later}) / 8.64e10), 0.0)"


CLEAN = f"""clean AS (SELECT * REPLACE (lower({strip('role')}) AS role) FROM messages
    WHERE session_id IS NOT NULL AND lower({strip('role')}) IN ('user', 'assistant', 'system') AND {strip('content')} <> '')"""
PAIRS = f"""{CLEAN}, pairs AS (
    SELECT session_id, turn, min(id) FILTER (WHERE role = 'user') AS first_msg_id, min(id) FILTER (WHERE role = 'assistant') AS last_msg_id,
           arg_min(content, id) FILTER (WHERE role = 'user') AS user_text, arg_min(content, id) FILTER (WHERE role = 'assistant') AS assistant_text
    FROM clean WHERE turn IS NOT NULL AND role <> 'system' GROUP BY session_id, turn
    HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0),
exch AS (SELECT *, 'User: ' || user_text || chr(10) || 'Assistant: ' || assistant_text AS text FROM pairs)"""

# Facts: the sequential rule, window by window.
_SELF = " OR ".join(f"contains(lower(v), '{m}')" for m in guards.SELF_REFERENCES)


def reason(reserved: tuple[str, ...] = ()) -> str:
    owned = " OR ".join([f"k = '{r}' OR ends_with(k, '_{r}')" for r in reserved]) or "false"
    gib = f"len([p FOR p IN string_split(k, '_') IF length(p) >= 4 AND NOT regexp_matches(p, '[aeiou]') AND NOT regexp_matches(p, '\\A[0-9]+\\z') AND p NOT IN {_list(guards.VOWELLESS_WORDS)}]) > 0"
    shaped = f"len([p FOR p IN string_split(k, '_') IF p IN {_list(guards.TRANSCRIPT_WORDS)}]) > 0"
    r = guards.REASONS
    return f"""CASE WHEN k = '' OR v = '' THEN '{r['empty']}' WHEN {owned} THEN '{r['reserved']}'
        WHEN source IN ('auto', 'rule') AND {shaped} THEN '{r['transcript']}' WHEN source = 'auto' AND {gib} THEN '{r['gibberish']}'
        WHEN {_SELF} THEN '{r['self']}' WHEN lower(v) IN {_list(guards.PLACEHOLDERS)} THEN '{r['placeholder']}' END"""


EVENTS = f"""once AS (SELECT DISTINCT * FROM fact_events WHERE ts IS NOT NULL),
checked AS (SELECT *, CASE WHEN op = 'forget' THEN CASE WHEN k = '' THEN '{guards.REASONS["empty"]}' END ELSE {reason()} END AS reason
    FROM (SELECT *, coalesce({norm_key('key')}, '') AS k, coalesce({strip('value')}, '') AS v FROM once)),
epochs AS (SELECT *, coalesce(sum(CASE WHEN op = 'forget' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM checked WHERE reason IS NULL),
said AS (SELECT *, row_number() OVER (PARTITION BY k, epoch ORDER BY ts, id) > 1 AND source = 'auto' AND length(v) < 2 AS short FROM epochs WHERE op <> 'forget'),
kept AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY k, epoch ORDER BY ts, id) = v, false) AS same FROM said WHERE NOT short),
grouped AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY ts, id) AS version FROM kept),
touched AS (SELECT k, version, max(ts) AS last_accessed_at FROM grouped WHERE same GROUP BY k, version),
forgets AS (SELECT k, epoch, ts AS forgotten_at FROM epochs WHERE op = 'forget'),
chain AS (SELECT *, lead(id) OVER w AS next_id, lead(ts) OVER w AS next_ts, lead(epoch) OVER w AS next_epoch FROM grouped WHERE NOT same WINDOW w AS (PARTITION BY k ORDER BY ts, id)),
versions AS (SELECT chain.id, chain.k AS key, v AS value, CASE WHEN chain.k IN {_list(PROFILE_KEYS)} THEN 'profile' ELSE 'note' END AS category, source,
    CASE source WHEN 'explicit' THEN 1.0::DOUBLE WHEN 'rule' THEN 0.7::DOUBLE WHEN 'auto' THEN 0.5::DOUBLE WHEN 'import' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS importance,
    ts AS valid_from, CASE WHEN next_epoch = chain.epoch THEN next_ts ELSE forgotten_at END AS invalidated_at, CASE WHEN next_epoch = chain.epoch THEN next_id END AS invalidated_by, last_accessed_at
    FROM chain LEFT JOIN forgets ON forgets.k = chain.k AND forgets.epoch = chain.epoch LEFT JOIN touched ON touched.k = chain.k AND touched.version = chain.version)"""

USABLE = """usable AS (SELECT * FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND embedding_model IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0)"""
ASKED = f"""{USABLE}, asked AS (SELECT s.id AS query_id, coalesce(title, '') AS text, u.embedding_model AS grp, u.embedding AS vec, s.id AS exclude_session
    FROM sessions s LEFT JOIN (SELECT session_id, arg_min(embedding_model, id) AS embedding_model, arg_min(embedding, id) AS embedding FROM usable GROUP BY session_id) u ON u.session_id = s.id WHERE s.id % 20 = 0)"""
QTERMS = f"qterms AS (SELECT query_id, unnest(ts) AS term FROM (SELECT query_id, {terms_of('text')} AS ts FROM asked))"


def bm25(name: str, docs: str, live: str = "") -> str:
    """CTEs ending in `name`(query_id, doc_id, bm25, rank) over docs(doc_id, text)."""
    return f"""{name}_docs AS ({docs}),
{name}_tok AS (SELECT doc_id, {index_of('text')} AS toks FROM {name}_docs),
{name}_stat AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM {name}_tok),
{name}_post AS (SELECT term, doc_id, len_, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len_, unnest(toks) AS term FROM {name}_tok) GROUP BY term, doc_id, len_),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY term),
{name}_score AS (SELECT query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len_ / avg_len))) AS bm25
    FROM qterms JOIN {name}_post USING (term) JOIN {name}_df USING (term), {name}_stat {live} GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 12) DESC, doc_id) AS rank FROM {name}_score) WHERE rank <= 20)"""


# Porter's algorithm in SQL, one CTE a step. A vowel y is written Y, so vowels and consonants are two character classes.
_V, _C = "[aeiouY]", "[^aeiouY]"


def _m1(c: str) -> str:
    return f"regexp_matches({c}, '{_V}{_C}')"


def _m2(c: str) -> str:
    return f"regexp_matches({c}, '{_V}+{_C}+{_V}+{_C}')"


def _short(c: str) -> str:
    return f"regexp_matches({c}, '{_C}{_V}[^aeiouYwxy]$')"


def _cut(c: str, n: int) -> str:
    return f"left({c}, length({c}) - {n})"


#: What stands before ion where it is cut off.
_ION = f" AND regexp_matches({_cut('w', 3)}, '[st]$')"


def _longest_suffix(rules: list[tuple[str, str]]) -> str:
    """The rule of the longest suffix that a word has; rules are (suffix, result)."""
    return "CASE " + " ".join(f"WHEN ends_with(w, '{old}') THEN {result}" for old, result in sorted(rules, key=lambda r: -len(r[0]))) + " ELSE w END"


def _mend(x: str) -> str:
    """A word after ed or ing was cut off."""
    return f"CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' WHEN length({x}) > 1 AND {x}[-1] = {x}[-2] AND regexp_matches({x}, '[^aeiouYlsz]$') THEN {_cut(x, 1)} WHEN {_m1(x)} AND NOT {_m2(x)} AND {_short(x)} THEN {x} || 'e' ELSE {x} END"


def stems(vocabulary: str) -> str:
    """CTEs ending in `stems`(term, stem) of the terms of a query."""
    replaced = [[(old, f"CASE WHEN {_m1(_cut('w', len(old)))} THEN {_cut('w', len(old))} || '{new}' ELSE w END") for old, new in table] for table in (_STEP2, _STEP3)]
    dropped = [(old, f"CASE WHEN {_m2(_cut('w', len(old)))}{_ION if old == 'ion' else ''} THEN {_cut('w', len(old))} ELSE w END") for old in _STEP4]
    steps = [
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m1(_cut('w', 3))} THEN {_cut('w', 1)} ELSE w END WHEN ends_with(w, 'ed') AND regexp_matches({_cut('w', 2)}, '{_V}') THEN {_mend('(' + _cut('w', 2) + ')')} WHEN ends_with(w, 'ing') AND regexp_matches({_cut('w', 3)}, '{_V}') THEN {_mend('(' + _cut('w', 3) + ')')} ELSE w END",
        f"CASE WHEN ends_with(lower(w), 'y') AND regexp_matches({_cut('w', 1)}, '{_V}') THEN {_cut('w', 1)} || 'i' ELSE w END",
        *map(_longest_suffix, replaced),
        _longest_suffix(dropped),
        f"CASE WHEN ends_with(w, 'e') AND ({_m2(_cut('w', 1))} OR {_m1(_cut('w', 1))} AND NOT {_short(_cut('w', 1))}) THEN {_cut('w', 1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_m2('w')} THEN {_cut('w', 1)} ELSE w END",
    ]
    out = [f"vocabulary AS ({vocabulary})", "p0 AS (SELECT term, regexp_replace(strip_accents(term), '([^aeiouy]|^y|[aeiou]y)y', '\\1Y', 'g') AS w FROM vocabulary WHERE regexp_matches(strip_accents(term), '\\A[a-z]{3,}\\z'))"]
    out += [f"p{i} AS (SELECT term, {step} AS w FROM p{i - 1})" for i, step in enumerate(steps, 1)]
    return ",\n".join([*out, f"stems AS (SELECT term, lower(w) AS stem FROM p{len(steps)} UNION ALL SELECT term, strip_accents(term) FROM vocabulary WHERE term NOT IN (SELECT term FROM p0))"])


def bm25_stemmed(name: str, live: str = "") -> str:
    """`bm25` over {name}_raw(term, doc_id, len_), the tokens of the documents, by stems; terms that stem alike count each."""
    return f"""{name}_stat AS (SELECT count(*) AS n, avg(len_) AS avg_len FROM {name}_docs),
{name}_post AS (SELECT stem AS term, doc_id, len_, count(*) AS tf FROM {name}_raw JOIN stems USING (term) GROUP BY stem, doc_id, len_),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY term),
{name}_score AS (SELECT query_id, doc_id, sum(weight * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len_ / avg_len))) AS bm25
    FROM qstems JOIN {name}_post USING (term) JOIN {name}_df USING (term), {name}_stat {live} GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 12) DESC, doc_id) AS rank FROM {name}_score) WHERE rank <= 20)"""


def _raw(name: str, docs: str) -> str:
    return f"""{name}_docs AS (SELECT doc_id, toks, len(toks) AS len_ FROM (SELECT doc_id, {index_of('text')} AS toks FROM ({docs}))), {name}_raw AS (SELECT unnest(toks) AS term, doc_id, len_ FROM {name}_docs)"""


_CHUNK_DOCS = "SELECT id AS doc_id, text FROM chunks"
_FACT_DOCS, _LIVE = "SELECT id AS doc_id, key || ' ' || value AS text FROM versions", "WHERE doc_id IN (SELECT id FROM versions WHERE invalidated_at IS NULL)"
_QSTEMS = "qstems AS (SELECT query_id, stem AS term, count(*) AS weight FROM qterms JOIN stems USING (term) GROUP BY query_id, stem)"
CHUNK_BM25 = bm25("cb", _CHUNK_DOCS)
FACT_BM25 = bm25("fb", _FACT_DOCS, _LIVE)
VECTOR = """vtop AS (SELECT * FROM (SELECT query_id, id AS doc_id, cos, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 12) DESC, id DESC) AS r
    FROM (SELECT query_id, u.id, list_cosine_similarity(a.vec::DOUBLE[], u.embedding::DOUBLE[]) AS cos FROM asked a JOIN usable u ON a.grp = u.embedding_model)) WHERE r <= 20),
vleg AS (SELECT query_id, doc_id, greatest(0.0, cos) / best AS vector FROM (SELECT *, max(cos) OVER (PARTITION BY query_id) AS best FROM vtop) WHERE best > 0)"""


def graph_ctes(asked: str = "asked", hops: int = 2) -> str:
    """CTEs und, names, seeds, reached, weights, cweights."""
    steps = ["reach0 AS (SELECT query_id, id, 0 AS depth FROM seeds)"]
    for h in range(1, hops + 1):
        steps.append(f"reach{h} AS (SELECT query_id, id, min(depth) AS depth FROM (SELECT * FROM reach{h - 1} UNION ALL SELECT query_id, b, {h} FROM reach{h - 1} JOIN und ON id = a) GROUP BY query_id, id)")
    return f"""und AS (SELECT source_node AS a, target_node AS b FROM graph_edges UNION SELECT target_node, source_node FROM graph_edges),
names AS (SELECT DISTINCT id, lower(name) AS name FROM (SELECT id, canonical_name AS name FROM graph_nodes UNION ALL SELECT id, unnest(aliases) FROM graph_nodes) WHERE name <> ''),
seeds AS (SELECT * FROM (SELECT query_id, id, length, row_number() OVER (PARTITION BY query_id ORDER BY length DESC, id) AS rank
    FROM (SELECT query_id, n.id, max(length(name)) AS length FROM {asked} q JOIN names n ON contains(lower(q.text), n.name) GROUP BY query_id, n.id)) WHERE rank <= 5),
{', '.join(steps)}, reached AS (SELECT * FROM reach{hops}),
rawname AS (SELECT query_id, canonical_name AS name, arg_max(coalesce(confidence, 0.5), n.id) * least(1.0, length(canonical_name) / 12.0) AS raw FROM reached r JOIN graph_nodes n ON n.id = r.id GROUP BY query_id, canonical_name),
weights AS (SELECT query_id, name, raw / CASE WHEN top = 0 THEN 1.0 ELSE top END AS weight FROM (SELECT *, max(raw) OVER (PARTITION BY query_id) AS top FROM rawname)),
firsthits AS (SELECT * FROM (SELECT w.name, c.id AS chunk_id, row_number() OVER (PARTITION BY w.name ORDER BY c.id) AS r FROM (SELECT DISTINCT name FROM weights) w JOIN chunks c ON contains(lower(c.text), w.name)) WHERE r <= 50),
cweights AS (SELECT query_id, chunk_id, max(weight) AS weight FROM firsthits JOIN weights USING (name) GROUP BY query_id, chunk_id)"""


def explained(hops: int = 2, k: int = 5, hide: bool = True) -> str:
    """CTEs ending in chunk_hits."""
    hidden = "WHERE c.session_id IS DISTINCT FROM f.query_id" if hide else ""
    return f"""fused AS (SELECT query_id, chunk_id, fts, vector, greatest(fts, vector) AS relevance, max(greatest(fts, vector)) OVER (PARTITION BY query_id) AS top FROM (
    SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.doc_id, v.doc_id) AS chunk_id, coalesce(60.0 / (59 + b.rank), 0.0) AS fts, coalesce(v.vector, 0.0) AS vector
    FROM cb b FULL JOIN vleg v ON b.query_id = v.query_id AND b.doc_id = v.doc_id)),
scored AS (SELECT f.*, c.session_id, c.text, c.created_at, coalesce(w.weight, 0) AS gw, (coalesce(c.importance, 0.5) - 0.5) * 0.15 AS importance_nudge, exp(-{days(AS_OF, 'c.created_at')} / 30.0) * 0.1 AS recency_nudge, coalesce(w.weight, 0) * top * 0.15 AS graph_nudge
    FROM fused f JOIN chunks c ON c.id = f.chunk_id LEFT JOIN cweights w ON w.query_id = f.query_id AND w.chunk_id = f.chunk_id {hidden}),
chunk_hits AS (SELECT * FROM (SELECT *, relevance + importance_nudge + recency_nudge + graph_nudge AS total, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance + importance_nudge + recency_nudge + graph_nudge, 12) DESC, chunk_id) AS rank FROM scored) WHERE rank <= {k})"""


FACT_HITS = f"""fact_hits AS (SELECT b.query_id, b.doc_id AS fact_id, b.rank, key, value, importance, valid_from, 60.0 / (59 + b.rank) AS relevance, exp(-{days(AS_OF, 'valid_from')} / 90.0) AS recency,
    CASE WHEN EXISTS (SELECT 1 FROM weights w WHERE w.query_id = b.query_id AND contains(lower(value), w.name)) THEN 0.15 ELSE 0.0 END AS graph_nudge FROM fb b JOIN versions v ON v.id = b.doc_id),
fact_scored AS (SELECT *, relevance * importance * recency + graph_nudge AS total FROM fact_hits)"""
RETRIEVAL = f"{EVENTS}, {ASKED}, {QTERMS}, {CHUNK_BM25}, {FACT_BM25}, {VECTOR}, {graph_ctes()}"
STEMMED_RETRIEVAL = f"""{EVENTS}, {ASKED}, {QTERMS}, {_raw("cb", _CHUNK_DOCS)}, {_raw("fb", _FACT_DOCS)}, {stems("SELECT term FROM cb_raw UNION SELECT term FROM fb_raw UNION SELECT term FROM qterms")}, {_QSTEMS},
{bm25_stemmed("cb")}, {bm25_stemmed("fb", _LIVE)}, {VECTOR}, {graph_ctes()}"""



def fit(source: str, keys: str, order: str, budget: int) -> str:
    """A SELECT of the fitted prefix with position and used."""
    return f"SELECT * FROM (SELECT *, row_number() OVER w AS position, CAST(sum({tokens_of('line')}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM {source} WINDOW w AS ({keys} ORDER BY {order})) WHERE used <= {budget}"


FACT_LINES = f"""fact_rows AS (SELECT q.query_id, v.id AS fact_id, '- ' || key || ': ' || value AS line, CASE WHEN category = 'profile' THEN 1 ELSE 0 END AS lead_, importance, valid_from,
    CASE WHEN category = 'profile' THEN 0.0 ELSE round(coalesce(60.0 / (59 + b.rank), 0.3) * (importance * exp(-{days(AS_OF, 'valid_from')} / 90.0)), 12) END AS score
    FROM asked q CROSS JOIN (SELECT * FROM versions WHERE invalidated_at IS NULL) v LEFT JOIN fb b ON b.query_id = q.query_id AND b.doc_id = v.id),
fact_lines AS ({fit('fact_rows', 'PARTITION BY query_id', 'lead_ DESC, score DESC, importance DESC, valid_from DESC, fact_id', _P.budgets.facts)})"""
EPISODIC_LINES = f"""epi_rows AS (SELECT query_id, rank, '- [' || strftime(created_at, '%Y-%m-%d') || '] ' || CASE WHEN length(one) > 240 THEN one[:240] || '…' ELSE one END AS line FROM (SELECT *, {squeeze('text')} AS one FROM chunk_hits)),
epi_lines AS ({fit('epi_rows', 'PARTITION BY query_id', 'rank', _P.budgets.episodic)})"""
GRAPH_LINES = f"""gl_rows AS (SELECT query_id, label, '- ' || coalesce(label || ': ', '') || string_agg(canonical_name, ', ' ORDER BY canonical_name) AS line FROM (SELECT DISTINCT query_id, nullif(cluster_label, '') AS label, canonical_name FROM reached r JOIN graph_nodes n ON n.id = r.id) GROUP BY query_id, label),
gl_lines AS ({fit('gl_rows', 'PARTITION BY query_id', '(label IS NULL), label', int(_P.budgets.episodic * 0.25))})"""
SESSION_LINES = f"""ss_rows AS (SELECT id, '- ' || summary AS line FROM sessions WHERE summary IS NOT NULL AND summary <> '' ORDER BY id DESC LIMIT 5), ss_lines AS ({fit('ss_rows', '', 'id', _P.budgets.sessions)})"""
LESSONS = f"""lesson_log AS (SELECT event_id AS seq, {strip("event_type || ' ' || json_extract_string(props, '$.k')")} AS text, event_type AS tag, ts FROM events),
lesson_rows AS (SELECT min(seq) AS id, text, arg_min(tag, seq) AS tag, arg_min(ts, seq) AS created_at, count(*) - 1 AS use_count FROM lesson_log WHERE text <> '' GROUP BY text),
lesson_all AS (SELECT *, row_number() OVER (ORDER BY id DESC) > 15 AS archived FROM lesson_rows)"""
LESSON_LINES = f"""ll_rows AS (SELECT id, '- ' || text AS line FROM lesson_all WHERE NOT archived ORDER BY id DESC LIMIT 5), ll_lines AS ({fit('ll_rows', '', 'id', _P.budgets.lessons)})"""


def _khop(hops: int) -> str:
    return f"""WITH RECURSIVE und AS (SELECT source_node AS a, target_node AS b FROM graph_edges UNION SELECT target_node, source_node FROM graph_edges),
        r AS (SELECT id AS query_id, id, 0 AS depth FROM graph_nodes WHERE id % 20 = 0 UNION SELECT query_id, b, depth + 1 FROM r JOIN und ON id = a WHERE depth < {hops})
        SELECT query_id, id, min(depth) AS depth FROM r GROUP BY query_id, id"""


def _clean_value(raw: str) -> str:
    words = rf"[w FOR w IN string_split_regex(regexp_replace(trim({raw}), '[.,!?]+\z', ''), '{_WS}+') IF w <> '']"
    return f"(SELECT coalesce(string_agg(w, ' ' ORDER BY p), '') FROM (SELECT w, p, min(CASE WHEN lower(w) IN {_list(rules.TRAILING_FILLER)} THEN p END) OVER () AS cut FROM (SELECT unnest({words}) AS w, generate_subscripts({words}, 1) AS p)) WHERE cut IS NULL OR p < cut)"


def _rules_sql() -> str:
    q = lambda p: p.replace("'", "''")
    singles = [f"SELECT id, {i} AS ord, '{key}' AS key, regexp_extract(content, '{q(p)}', 1) AS raw FROM u" for i, (p, key) in enumerate(rules.RULES)]
    pref = q(rules.PREFERENCE)
    return f"""WITH {CLEAN}, u AS (SELECT id, content FROM clean WHERE role = 'user'),
        single AS (SELECT id, ord, key, {_clean_value('raw')} AS value FROM ({' UNION ALL '.join(singles)}) WHERE raw <> ''),
        likes AS (SELECT id, {len(rules.RULES)} + p - 1 AS ord, 'favorite_' || replace(lower(trim(s)), ' ', '_') AS key, {_clean_value('v')} AS value
            FROM (SELECT id, unnest(regexp_extract_all(content, '{pref}', 1)) AS s, unnest(regexp_extract_all(content, '{pref}', 2)) AS v, generate_subscripts(regexp_extract_all(content, '{pref}', 1), 1) AS p FROM u))
        SELECT * FROM single WHERE value <> '' AND lower(split_part(value, ' ', 1)) NOT IN {_list(rules.LEADING_STOPWORDS)} UNION ALL SELECT * FROM likes WHERE value <> ''"""


_RELATION = squeeze("lower(relationship)")
#: Token budgets by their formula, from the default settings.
_BUDGETS = """WITH d AS (SELECT greatest(256, 4096 - 512 - 600 - 0) AS dynamic), w AS (SELECT dynamic, CAST(trunc(dynamic * 0.55::DOUBLE) AS INTEGER) AS base FROM d),
    s AS (SELECT tier, base, dynamic - base AS pool, tier = 'lite' AS lite FROM w, (VALUES ('lite'), ('standard'), ('full')) t(tier))
    SELECT tier, CAST(base + CASE WHEN lite THEN trunc(pool * (0.3::DOUBLE * (1 - 0.45::DOUBLE) + 0.15::DOUBLE * (1 - 0.75::DOUBLE))) ELSE 0 END AS INTEGER) AS working,
        CAST(trunc(pool * 0.4::DOUBLE) AS INTEGER) AS facts, CAST(trunc(pool * CASE WHEN lite THEN 0.3::DOUBLE * 0.45::DOUBLE ELSE 0.3::DOUBLE END) AS INTEGER) AS episodic,
        CAST(trunc(pool * CASE WHEN lite THEN 0.15::DOUBLE * 0.75::DOUBLE ELSE 0.15::DOUBLE END) AS INTEGER) AS sessions, CAST(trunc(pool * 0.15::DOUBLE) AS INTEGER) AS lessons,
        CASE tier WHEN 'full' THEN 5 WHEN 'standard' THEN 4 ELSE 3 END AS top_k, CASE tier WHEN 'full' THEN 2 ELSE 1 END AS hops FROM s"""
_TELEMETRY = "tele AS (SELECT user_id AS host, ts, event_id AS id, least(30.0, value / 2) AS available FROM events), meas AS (SELECT *, CASE WHEN available >= 6 THEN 2 WHEN available >= 2.5 THEN 1 ELSE 0 END AS measured, available < 1.2 AS starved, row_number() OVER (PARTITION BY host ORDER BY ts, id) AS n FROM tele)"
_DECAY_NODES = f"SELECT * FROM graph_nodes WHERE coalesce(confidence, 0.5) * exp(-{days(AS_OF, 'updated_at')} / 120.0) >= 0.15"
_COMPONENTS = """WITH RECURSIVE ends AS (SELECT source_node AS a, target_node AS b FROM graph_edges WHERE source_node <> target_node AND source_node IN (SELECT id FROM graph_nodes) AND target_node IN (SELECT id FROM graph_nodes)),
    und AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends), walk AS (SELECT a AS id, a AS r FROM und UNION SELECT b, r FROM walk JOIN und ON id = a),
    comp AS (SELECT id, min(r) AS cluster_id FROM walk GROUP BY id)"""
def merges(nodes: str = "graph_nodes", review: int = 365) -> str:
    """CTEs ending in `chosen`: the first five pairs of recent nodes of one type that share a word."""
    return f"""recent AS (SELECT id, type, canonical_name, created_at, list_distinct(string_split(canonical_name, ' ')) AS words FROM {nodes} WHERE created_at >= date_trunc('day', {AS_OF} - INTERVAL {review} DAY)),
    chosen AS (SELECT a.id AS keep_id, b.id AS drop_id, a.canonical_name AS keep_name, b.canonical_name AS drop_name FROM recent a JOIN recent b ON a.type = b.type AND list_has_any(a.words, b.words) AND (a.created_at, a.id) < (b.created_at, b.id)
        ORDER BY a.created_at, a.id, b.created_at, b.id LIMIT 5)"""


def merge_applied(edges: str) -> str:
    """CTEs after `chosen`, ending in `medges`: the edges with dropped ends moved to what they were merged into, without repeats."""
    return f"""c1 AS (SELECT drop_id, min(keep_id) AS keep_id FROM chosen GROUP BY drop_id),
    up AS (SELECT drop_id, keep_id FROM c1 UNION SELECT up.drop_id, c1.keep_id FROM up JOIN c1 ON up.keep_id = c1.drop_id),
    root AS (SELECT drop_id, keep_id FROM up WHERE keep_id NOT IN (SELECT drop_id FROM c1)),
    moved AS (SELECT e.* REPLACE (coalesce(s.keep_id, e.source_node) AS source_node, coalesce(t.keep_id, e.target_node) AS target_node) FROM {edges} e LEFT JOIN root s ON e.source_node = s.drop_id LEFT JOIN root t ON e.target_node = t.drop_id),
    medges AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY source_node, target_node, relationship ORDER BY id) = 1)"""


_SWEEP = f"""n0 AS ({_DECAY_NODES}),
    e0 AS (SELECT * FROM graph_edges WHERE coalesce(confidence, 0.5) * exp(-{days(AS_OF, 'last_seen')} / 120.0) >= 0.15 AND source_node IN (SELECT id FROM n0) AND target_node IN (SELECT id FROM n0)),
    {merges('n0')}, {merge_applied('e0')},
    n2 AS (SELECT * FROM n0 WHERE id NOT IN (SELECT drop_id FROM c1) ORDER BY importance DESC NULLS LAST, mention_count DESC NULLS LAST, updated_at DESC NULLS LAST, id LIMIT 2000),
    e2 AS (SELECT * FROM medges WHERE source_node IN (SELECT id FROM n2) AND target_node IN (SELECT id FROM n2) ORDER BY importance DESC NULLS LAST, seen_count DESC NULLS LAST, last_seen DESC NULLS LAST, id LIMIT 5000),
    und AS (SELECT source_node AS a, target_node AS b FROM e2 WHERE source_node <> target_node UNION SELECT target_node, source_node FROM e2 WHERE source_node <> target_node),
    walk AS (SELECT a AS id, a AS r FROM und UNION SELECT b, r FROM walk JOIN und ON id = a), comp AS (SELECT id, min(r) AS cluster_id FROM walk GROUP BY id)"""

#: The three longest words of what a model sees of each exchange, longest first.
_LONGEST = f"""{PAIRS}, longest AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY length(word) DESC, word) AS r
    FROM (SELECT DISTINCT first_msg_id AS id, unnest(regexp_extract_all('User said: ' || user_text || chr(10) || 'Assistant replied: ' || left(assistant_text, 400), '[A-Za-z]{{6,}}')) AS word FROM exch) QUALIFY r <= 3)"""
#: White space by which Python splits words.
_SPLIT = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


SQL: dict[str, str] = {
    "exchange_pairing": f"WITH {PAIRS} SELECT session_id, turn, first_msg_id, last_msg_id, text FROM exch",
    "session_rollup": f"""WITH {CLEAN}, stats AS (SELECT session_id, count(*) AS n, arg_min(content, id) FILTER (WHERE role = 'user') AS first_text FROM clean GROUP BY session_id)
        SELECT id, started_at, coalesce(ended_at, {AS_OF}) AS ended_at, coalesce(title, left(first_text, 80)) AS title, summary, coalesce(n, 0) AS message_count, ended_at IS NULL AS was_open FROM sessions LEFT JOIN stats ON stats.session_id = id""",
    "session_tail_budget": f"""WITH {CLEAN}, r AS (SELECT session_id, id, role, greatest(1, coalesce(token_estimate, {tokens_of('content')})) AS cost FROM clean WHERE role <> 'system'),
        t AS (SELECT *, row_number() OVER w AS back, CAST(sum(cost) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM r WINDOW w AS (PARTITION BY session_id ORDER BY id DESC))
        SELECT session_id, id, role, back, used FROM t WHERE used <= 500 OR back = 1""",
    "chunk_packing": rf"""WITH RECURSIVE {PAIRS}, sents AS (SELECT session_id, turn, text, {tokens_of('text')} <= 400 AS fits, string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)) AS s FROM exch),
        fold AS (SELECT session_id, turn, s, 0 AS i, '' AS buf, []::VARCHAR[] AS out FROM sents WHERE NOT fits UNION ALL
            SELECT session_id, turn, s, i + 1, CASE WHEN full_ THEN s[i + 1] ELSE longer END, CASE WHEN full_ THEN list_append(out, buf) ELSE out END
            FROM (SELECT *, buf <> '' AND {tokens_of('longer')} > 400 AS full_ FROM (SELECT *, {strip("buf || ' ' || s[i + 1]")} AS longer FROM fold WHERE i < len(s)))),
        done AS (SELECT session_id, turn, CASE WHEN buf <> '' THEN list_append(out, buf) ELSE out END AS parts FROM fold WHERE i = len(s) UNION ALL SELECT session_id, turn, [text] FROM sents WHERE fits)
        SELECT session_id, turn, generate_subscripts(parts, 1) - 1 AS piece, unnest(parts) AS text FROM done""",
    "extractive_summary": f"""WITH {CLEAN}, one AS (SELECT session_id, id, {squeeze('content')} AS t FROM clean WHERE role = 'user'),
        pos AS (SELECT *, instr(t, '. ') AS a, instr(t, '? ') AS b, instr(t, '! ') AS c FROM one),
        cl AS (SELECT session_id, id, CASE WHEN a BETWEEN 2 AND 121 THEN t[:a] WHEN b BETWEEN 2 AND 121 THEN t[:b] WHEN c BETWEEN 2 AND 121 THEN t[:c] ELSE trim(t[:120]) END AS clause FROM pos),
        uniq AS (SELECT session_id, arg_min(clause, id) AS clause, min(id) AS id FROM cl WHERE clause <> '' GROUP BY session_id, lower(clause)),
        lines AS (SELECT session_id, id, '- ' || clause AS line FROM uniq), fitted AS ({fit('lines', 'PARTITION BY session_id', 'id DESC', 120)})
        SELECT session_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY id) AS summary FROM fitted GROUP BY session_id""",
    "token_estimates": f"SELECT id, {tokens_of('content')} AS tokens FROM messages WHERE content IS NOT NULL",
    "batched_cadence": f"WITH {PAIRS} SELECT session_id, batch, count(*) AS turns, min(turn) AS first_turn, max(last_msg_id) AS last_msg_id FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1) // 2 AS batch FROM exch) GROUP BY session_id, batch",
    "query_term_list": f"SELECT id, array_to_string({terms_of('title')}, ' ') AS terms FROM sessions WHERE title IS NOT NULL",
    "postings_stats": f"WITH p AS (SELECT id, unnest({index_of('text')}) AS term FROM chunks), c AS (SELECT term, id, count(*) AS tf FROM p GROUP BY term, id) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM c GROUP BY term",
    "bm25_topk": f"WITH {ASKED}, {QTERMS}, {CHUNK_BM25} SELECT query_id, doc_id, rank, round(bm25, 6) AS bm25 FROM cb",
    "bm25_porter": f"""WITH {ASKED}, {QTERMS}, {_raw("cb", _CHUNK_DOCS)}, {stems("SELECT term FROM cb_raw UNION SELECT term FROM qterms")}, {_QSTEMS}, {bm25_stemmed("cb")} SELECT query_id, doc_id, rank, round(bm25, 6) AS bm25 FROM cb""",
    "like_fallback": f"""WITH {ASKED}, t8 AS (SELECT query_id, unnest({terms_of('text')}[:8]) AS term FROM asked),
        hit AS (SELECT query_id, c.id AS doc_id, count(*) AS hits FROM t8 JOIN chunks c ON contains(lower(c.text), term) GROUP BY query_id, c.id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM hit) WHERE rank <= 20""",
    "cosine_topk": f"""WITH {USABLE}, p AS (SELECT q.id AS query_id, u.id, list_cosine_similarity(q.embedding::DOUBLE[], u.embedding::DOUBLE[]) AS cos FROM usable q JOIN usable u ON q.embedding_model = u.embedding_model WHERE q.id % 20 = 0)
        SELECT query_id, id, rank, round(cos, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 12) DESC, id DESC) AS rank FROM p) WHERE rank <= 20""",
    "fact_versions": f"WITH {EVENTS} SELECT * FROM versions",
    "fact_outcomes": f"""WITH {EVENTS} SELECT id, false AS changed, reason FROM checked WHERE op <> 'forget' AND reason IS NOT NULL UNION ALL SELECT id, false, 'kept existing value' FROM said WHERE short
        UNION ALL SELECT id, NOT same, CASE WHEN same THEN 'already stored' ELSE 'stored' END FROM kept""",
    "facts_current": f"WITH {EVENTS} SELECT id, key, value, category, importance, valid_from FROM versions WHERE invalidated_at IS NULL",
    "fact_history": f"""WITH {EVENTS}, asked AS (SELECT DISTINCT k FROM (SELECT {norm_key('key')} AS k FROM fact_events WHERE id % 20 = 0))
        SELECT key, row_number() OVER (PARTITION BY key ORDER BY valid_from, id) AS version, id, value, valid_from, invalidated_at FROM versions WHERE key IN (SELECT k FROM asked)""",
    "fact_forget": f"WITH {EVENTS} SELECT id, key, invalidated_at FROM versions WHERE invalidated_at IS NOT NULL AND invalidated_by IS NULL",
    "fact_as_of": f"WITH {EVENTS} SELECT id, key, value FROM versions WHERE valid_from <= TIMESTAMP '2024-10-01' AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '2024-10-01')",
    "validate_fact": f"SELECT id, coalesce({reason(('timezone',))}, 'ok') AS reason FROM (SELECT DISTINCT id, source, coalesce({norm_key('key')}, '') AS k, coalesce({strip('value')}, '') AS v FROM fact_events WHERE op = 'remember')",
    "quarantine_cap": f"""WITH {EVENTS} SELECT id, key[:200] AS key, value[:500] AS value, reason, source FROM (
        SELECT id, key, value, reason, source FROM checked WHERE op <> 'forget' AND reason IS NOT NULL AND source IN ('auto', 'rule')
        UNION ALL SELECT id, key, value, 'too short to override the existing value', source FROM said WHERE short) ORDER BY id DESC LIMIT 200""",
    "fact_decay": f"""WITH {EVENTS}, d AS (SELECT id, key, source, importance * exp(-{days(AS_OF, 'coalesce(last_accessed_at, valid_from)')} / 60.0) AS e FROM versions WHERE invalidated_at IS NULL)
        SELECT id, key, source = 'auto' AND e < 0.15 AS archived, round(e, 6) AS effective FROM d""",
    "access_touch": f"""WITH {EVENTS}, a AS (SELECT user_id, count(*) AS n, max(ts) AS ts FROM events GROUP BY user_id)
        SELECT id, key, coalesce(n, 0) AS access_count, greatest(last_accessed_at, a.ts) AS last_accessed_at FROM versions LEFT JOIN a ON a.user_id = id WHERE invalidated_at IS NULL""",
    "fact_contradictions": f"""WITH {EVENTS} SELECT o.key, o.value AS old_value, n.value AS new_value, n.id AS new_id FROM versions o JOIN versions n ON n.id = o.invalidated_by
        WHERE o.invalidated_at >= date_trunc('day', {AS_OF} - INTERVAL 120 DAY) AND n.invalidated_at IS NULL ORDER BY o.id LIMIT 5""",
    "rule_capture": _rules_sql(),
    "importance_bump": f"WITH cap AS ({_rules_sql()}) SELECT c.id, CASE WHEN first_msg_id IN (SELECT id FROM cap) THEN greatest(importance, 0.8) ELSE importance END AS importance FROM chunks c",
    "graph_nodes_upsert": f"""WITH log AS (SELECT id, type, canonical_name AS name, confidence, mention_count AS n, updated_at AS ts FROM graph_nodes UNION ALL SELECT id, type, unnest(aliases), confidence, 1, created_at FROM graph_nodes),
        r AS (SELECT *, {canonical('name')} AS cn, {strip('name')} AS raw FROM log),
        first AS (SELECT type, cn, raw, min({{'t': ts, 'i': id}}) AS seen FROM r WHERE raw <> cn GROUP BY type, cn, raw QUALIFY row_number() OVER (PARTITION BY type, cn ORDER BY seen DESC, raw) <= 8),
        spelt AS (SELECT type, cn, string_agg(raw, '|' ORDER BY seen DESC, raw) AS aliases FROM first GROUP BY type, cn)
        SELECT min(id) AS id, type, cn AS canonical_name, CAST(sum(n) AS BIGINT) AS mention_count, min(ts) AS created_at, max(ts) AS updated_at, round(sum(coalesce(confidence, 0.5) * n) / sum(n), 6) AS confidence, coalesce(any_value(aliases), '') AS aliases
        FROM r LEFT JOIN spelt USING (type, cn) WHERE cn <> '' GROUP BY type, cn""",
    "graph_edges_upsert": f"""SELECT min(id) AS id, source_node, target_node, {_RELATION} AS relationship, CAST(sum(seen_count) AS BIGINT) AS seen_count, arg_min(created_at, id) AS created_at, max(last_seen) AS last_seen, arg_min_null(source_chunk_id, id) AS source_chunk_id,
        round(sum(coalesce(confidence, 0.5) * seen_count) / sum(seen_count), 6) AS confidence FROM graph_edges WHERE {_RELATION} <> '' AND source_node <> target_node GROUP BY source_node, target_node, {_RELATION}""",
    "graph_caps": """WITH n AS (SELECT id FROM graph_nodes ORDER BY importance DESC NULLS LAST, mention_count DESC NULLS LAST, updated_at DESC NULLS LAST, id LIMIT 300),
        e AS (SELECT id FROM graph_edges WHERE source_node IN (SELECT id FROM n) AND target_node IN (SELECT id FROM n) ORDER BY importance DESC NULLS LAST, seen_count DESC NULLS LAST, last_seen DESC NULLS LAST, id LIMIT 400)
        SELECT 'node' AS kind, id FROM n UNION ALL SELECT 'edge', id FROM e""",
    "graph_seeds": f"WITH asked AS (SELECT id AS query_id, text FROM chunks WHERE id % 20 = 0), {graph_ctes(hops=1)} SELECT query_id, id, length, rank FROM seeds",
    "graph_khop_1": _khop(1),
    "graph_khop_2": _khop(2),
    "graph_decay": f"""WITH n AS ({_DECAY_NODES}) SELECT 'node' AS kind, id FROM n UNION ALL SELECT 'edge', id FROM graph_edges
        WHERE coalesce(confidence, 0.5) * exp(-{days(AS_OF, 'last_seen')} / 120.0) >= 0.15 AND source_node IN (SELECT id FROM n) AND target_node IN (SELECT id FROM n)""",
    "graph_clusters": f"{_COMPONENTS} SELECT id, cluster_id FROM comp",
    "cluster_listing": f"""{_COMPONENTS}, m AS (SELECT comp.cluster_id, n.* EXCLUDE (cluster_id) FROM comp JOIN graph_nodes n USING (id)), f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM m)
        SELECT cluster_id, max(cluster_label) AS label, count(*) AS size, string_agg(canonical_name, ', ' ORDER BY id) FILTER (WHERE r <= 12) AS names FROM f GROUP BY cluster_id""",
    "graph_merge_candidates": f"WITH {merges()} SELECT * FROM chosen",
    "graph_chunk_weights": f"WITH asked AS (SELECT id AS query_id, text FROM chunks WHERE id % 20 = 0), {graph_ctes(hops=1)} SELECT query_id, chunk_id, round(weight, 6) AS weight FROM cweights",
    "hybrid_recall": f"""WITH {RETRIEVAL}, {explained(hide=False)}, {FACT_HITS},
        hits AS (SELECT query_id, 'chunk' AS kind, chunk_id AS id, strftime(created_at, '%Y-%m-%d') AS date, total AS score, rank AS r FROM chunk_hits UNION ALL SELECT query_id, 'fact', fact_id, strftime(valid_from, '%Y-%m-%d'), total, rank FROM fact_scored)
        SELECT query_id, rank, kind, id, date, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, kind, r) AS rank FROM hits) WHERE rank <= 5""",
    "hybrid_recall_stemmed": f"""WITH {STEMMED_RETRIEVAL}, {explained(hide=False)}, {FACT_HITS},
        hits AS (SELECT query_id, 'chunk' AS kind, chunk_id AS id, strftime(created_at, '%Y-%m-%d') AS date, total AS score, rank AS r FROM chunk_hits UNION ALL SELECT query_id, 'fact', fact_id, strftime(valid_from, '%Y-%m-%d'), total, rank FROM fact_scored)
        SELECT query_id, rank, kind, id, date, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, kind, r) AS rank FROM hits) WHERE rank <= 5""",
    "explain_breakdown": f"""WITH {RETRIEVAL}, {explained()},
        lit AS (SELECT h.query_id, h.chunk_id, string_agg(name, ', ' ORDER BY name) AS graph_names FROM chunk_hits h JOIN weights w ON w.query_id = h.query_id AND contains(lower(h.text), w.name) WHERE gw > 0 GROUP BY h.query_id, h.chunk_id)
        SELECT h.query_id, rank, h.chunk_id, coalesce(graph_names, '') AS graph_names, round(fts, 6) AS fts, round(vector, 6) AS vector, round(relevance, 6) AS relevance, round(importance_nudge, 6) AS importance_nudge, round(recency_nudge, 6) AS recency_nudge, round(graph_nudge, 6) AS graph_nudge, round(total, 6) AS total
        FROM chunk_hits h LEFT JOIN lit ON lit.query_id = h.query_id AND lit.chunk_id = h.chunk_id""",
    "explain_facts": f"WITH {RETRIEVAL}, {FACT_HITS} SELECT query_id, fact_id, rank, round(relevance, 6) AS relevance, round(importance, 6) AS importance, round(recency, 6) AS recency, round(graph_nudge, 6) AS graph_nudge, round(total, 6) AS total FROM fact_scored",
    "timeline_lookup": f"""WITH {EVENTS}, asked AS (SELECT DISTINCT id AS query_id, CASE WHEN id % 40 = 0 THEN key ELSE coalesce(value, '') END AS text FROM fact_events WHERE id % 20 = 0), {QTERMS}, {FACT_BM25},
        ex AS (SELECT query_id, {norm_key('text')} AS k FROM asked), hit AS (SELECT query_id, key FROM fb JOIN versions v ON v.id = fb.doc_id WHERE rank = 1),
        res AS (SELECT a.query_id, coalesce(e.k, h.key) AS key, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN h.key IS NOT NULL THEN 'search' ELSE 'none' END AS resolved_by
            FROM asked a LEFT JOIN (SELECT * FROM ex WHERE k IN (SELECT key FROM versions)) e ON e.query_id = a.query_id LEFT JOIN hit h ON h.query_id = a.query_id)
        SELECT res.query_id, res.key, resolved_by, version, v.id, v.value, v.valid_from, v.invalidated_at FROM res LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid_from, id) AS version FROM versions) v ON v.key = res.key""",
    "facts_section": f"WITH {EVENTS}, {ASKED}, {QTERMS}, {FACT_BM25}, {FACT_LINES} SELECT query_id, fact_id, line, position, used FROM fact_lines",
    "episodic_section": f"WITH {RETRIEVAL}, {explained()}, {EPISODIC_LINES} SELECT query_id, line, position, used FROM epi_lines",
    "graph_section": f"WITH asked AS (SELECT id AS query_id, text FROM chunks WHERE id % 20 = 0), {graph_ctes()}, {GRAPH_LINES} SELECT query_id, line, position, used FROM gl_lines",
    "sessions_section": f"WITH {SESSION_LINES} SELECT id, line, position, used FROM ss_lines",
    "lessons_section": f"WITH {LESSONS}, {LESSON_LINES} SELECT id, line, position, used FROM ll_lines",
    "lessons_upsert": f"WITH {LESSONS} SELECT id, text, tag, created_at, use_count, archived FROM lesson_all",
    "context_render": f"""WITH {RETRIEVAL}, {explained()}, {FACT_LINES}, {EPISODIC_LINES}, {GRAPH_LINES}, {SESSION_LINES}, {LESSONS}, {LESSON_LINES},
        body AS (SELECT query_id, 0 AS i, string_agg(line, chr(10) ORDER BY position) AS b FROM fact_lines GROUP BY query_id UNION ALL SELECT query_id, 1, string_agg(line, chr(10) ORDER BY position) FROM gl_lines GROUP BY query_id
            UNION ALL SELECT query_id, 2, string_agg(line, chr(10) ORDER BY position) FROM epi_lines GROUP BY query_id UNION ALL SELECT query_id, 3, b FROM asked, (SELECT string_agg(line, chr(10) ORDER BY position) AS b FROM ss_lines)
            UNION ALL SELECT query_id, 4, b FROM asked, (SELECT string_agg(line, chr(10) ORDER BY position) AS b FROM ll_lines))
        SELECT query_id, string_agg({_list([t for _, t in SECTIONS]).replace('(', '[', 1).rpartition(')')[0]}][i + 1] || chr(10) || b, chr(10) || chr(10) ORDER BY i) AS prompt FROM body WHERE b IS NOT NULL AND b <> '' GROUP BY query_id""",
    "governor_classify": "SELECT event_id AS id, CASE WHEN least(30.0, value / 2) >= 6 THEN 2 WHEN least(30.0, value / 2) >= 2.5 THEN 1 ELSE 0 END AS tier FROM events",
    "governor_budgets": _BUDGETS,
    "governor_fold": f"""WITH RECURSIVE {_TELEMETRY}, f AS (SELECT host, 0::BIGINT AS n, 0::BIGINT AS id, 0 AS measured, 2 AS tier, 0 AS streak FROM (SELECT DISTINCT host FROM tele) UNION ALL
        SELECT m.host, m.n, m.id, m.measured,
            CASE WHEN m.starved THEN 0 WHEN m.measured < f.tier THEN m.measured WHEN m.measured > f.tier AND f.streak + 1 >= 3 THEN least(f.tier + 1, 2) ELSE f.tier END,
            CASE WHEN m.starved THEN CASE WHEN f.tier = 0 THEN f.streak ELSE 0 END WHEN m.measured > f.tier THEN CASE WHEN f.streak + 1 >= 3 THEN 0 ELSE f.streak + 1 END ELSE 0 END
        FROM f JOIN meas m ON m.host = f.host AND m.n = f.n + 1)
        SELECT host, id, measured, tier FROM f WHERE n > 0""",
    "store_stats": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("sessions", "messages", "chunks", "fact_events", "graph_nodes", "graph_edges")),
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS started_at, count(*) AS events FROM s GROUP BY user_id, n""",
    "rolling_summary": f"""WITH {CLEAN}, one AS (SELECT session_id, id, {squeeze('content')} AS t FROM clean WHERE role = 'user'),
        pos AS (SELECT *, instr(t, '. ') AS a, instr(t, '? ') AS b, instr(t, '! ') AS c FROM one),
        cl AS (SELECT session_id, id, CASE WHEN a BETWEEN 2 AND 121 THEN t[:a] WHEN b BETWEEN 2 AND 121 THEN t[:b] WHEN c BETWEEN 2 AND 121 THEN t[:c] ELSE trim(t[:120]) END AS said FROM pos),
        every AS (SELECT session_id, id, said, '- ' || said AS line FROM cl WHERE said <> '' UNION ALL SELECT id, -4611686018427387904, rolling_summary, rolling_summary FROM sessions WHERE rolling_summary <> ''),
        uniq AS (SELECT session_id, min(id) AS id, arg_min(line, id) AS line FROM every GROUP BY session_id, lower(said)), fitted AS ({fit('uniq', 'PARTITION BY session_id', 'id DESC', 200)})
        SELECT session_id, string_agg(line, chr(10) ORDER BY id) AS summary FROM fitted GROUP BY session_id""",
    "toy_embed": rf"""WITH w AS (SELECT id, left(trim(unnest(regexp_split_to_array(lower(text), '{_SPLIT}')), '.,!?'')("'), 5) AS begins FROM chunks WHERE text IS NOT NULL),
        c AS (SELECT id, CAST('0x' || right(md5(begins), 2) AS INTEGER) % 64 AS b, count(*) AS n FROM w WHERE length(begins) >= 3 GROUP BY ALL), l AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id),
        v AS (SELECT k.id, list(CAST(coalesce(n, 0) / coalesce(norm, 1.0) AS FLOAT) ORDER BY i.b) AS embedding FROM (SELECT id FROM chunks WHERE text IS NOT NULL) k CROSS JOIN range(64) i(b) LEFT JOIN c ON c.id = k.id AND c.b = i.b LEFT JOIN l ON l.id = k.id GROUP BY k.id)
        SELECT chunks.id, v.embedding FROM chunks LEFT JOIN v ON v.id = chunks.id""",
    "llm_extract_parse": f"WITH {_LONGEST} SELECT id, CAST(r - 1 AS INTEGER) AS pos, 'thing' AS type, word AS name FROM longest",
    "llm_extract_facts": f"WITH {_LONGEST} SELECT id, 'topic_' || (r - 1) AS key, word AS value FROM longest",
    "llm_extract_relationships": f"WITH {_LONGEST} SELECT a.id, CAST(a.r - 1 AS INTEGER) AS pos, a.word AS source, 'with' AS relation, b.word AS target, CAST(NULL AS BIGINT) AS source_chunk_id FROM longest a JOIN longest b ON a.id = b.id AND b.r = a.r + 1",
    "graph_extraction_store": f"""WITH {_LONGEST} SELECT 'node' AS kind, lower(word) AS name, 2 * count(*) AS n FROM longest GROUP BY lower(word)
        UNION ALL SELECT 'edge', lower(a.word) || ' with ' || lower(b.word), 2 * count(*) FROM longest a JOIN longest b ON a.id = b.id AND b.r = a.r + 1 WHERE lower(a.word) <> lower(b.word) GROUP BY ALL""",
    "graph_merge_apply": f"WITH RECURSIVE {merges()}, {merge_applied('graph_edges')} SELECT id, source_node, target_node, relationship FROM medges",
    "consolidate_sweep": f"""WITH RECURSIVE {EVENTS}, d AS (SELECT id, importance * exp(-{days(AS_OF, 'coalesce(last_accessed_at, valid_from)')} / 60.0) AS effective, source, importance FROM versions WHERE invalidated_at IS NULL), {_SWEEP}
        SELECT 'archived' AS name, (SELECT count(*) FROM d WHERE source = 'auto' AND effective < 0.15) AS rows UNION ALL SELECT 'nodes', count(*) FROM n2 UNION ALL SELECT 'edges', count(*) FROM e2 UNION ALL SELECT 'clustered', count(*) FROM comp""",
    "cluster_labels": f"""WITH RECURSIVE {_SWEEP}, m AS (SELECT comp.cluster_id AS cid, n2.* FROM comp JOIN n2 USING (id)), f AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY id) AS p FROM m),
        named AS (SELECT cid, regexp_replace(trim(trim(split_part(string_agg(canonical_name, ', ' ORDER BY id) FILTER (WHERE p <= 12), ',', 1), chr(32) || chr(9) || chr(10) || chr(13))), '\\A["'']+|["''.]+\\z', '', 'g') AS label, bool_or(coalesce(cluster_label, '') = '') AS missing FROM f GROUP BY cid)
        SELECT n2.id, comp.cluster_id, CASE WHEN comp.cluster_id IS NOT NULL THEN coalesce(CASE WHEN missing AND length(label) BETWEEN 1 AND 60 THEN label END, nullif(n2.cluster_label, '')) END AS cluster_label FROM n2 LEFT JOIN comp USING (id) LEFT JOIN named ON cid = comp.cluster_id""",
}
