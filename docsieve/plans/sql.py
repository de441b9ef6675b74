"""DuckDB statements with the results of the registered queries, made from the same catalogs."""

from __future__ import annotations

from docsieve.functions import catalogs as C
from docsieve.operators import report

NAMES = ("anan", "Ontion", "keit der")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(regex: str, ignore_case: bool) -> str:
    """A pattern for RE2, which takes no nested bounds as large as the catalog's."""
    return q(("(?i)" if ignore_case else "") + regex.replace("{0,126}", "*"))


def hits(text: str, regex: str, ignore_case: bool) -> str:
    """A list of (text, s, e) of a pattern's matches."""
    p = rx(regex, ignore_case)
    m, g = f"regexp_extract_all({text}, {p})", f"regexp_split_to_array({text}, {p})"
    gaps = "coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)"
    before = "coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)"
    start = gaps + " + " + before
    start = start.replace("gs[", f"{g}[").replace("ms[", f"{m}[")
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'text': {m}[i], 's': CAST({start} AS BIGINT)}})"


def flat_hits(source: str, keys: str, name_column: str, rows: list[tuple[str, str, bool]]) -> str:
    """UNION of (keys, name, text, s) of several patterns over one source."""
    parts = [f"SELECT {keys}, {q(name)} AS {name_column}, unnest({hits('text', regex, case)}) AS h FROM {source}" for name, regex, case in rows]
    return " UNION ALL ".join(parts)


def around(text: str, start: str, end: str, n: int) -> str:
    space = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    cut = f"regexp_replace(substring({text}, CAST(greatest(0, {start} - {n}) + 1 AS BIGINT), CAST(least(length({text}), {end} + {n}) - greatest(0, {start} - {n}) AS BIGINT)), '^{space}+|{space}+$', '', 'g')"
    return f"CASE WHEN {start} - {n} > 0 THEN '...' ELSE '' END || {cut} || CASE WHEN {end} + {n} < length({text}) THEN '...' ELSE '' END"


def count(text: str, regex: str, ignore_case: bool = True) -> str:
    return f"CAST(len(regexp_extract_all({text}, {rx(regex, ignore_case)})) AS BIGINT)"


PERSONAL = {p.name: f"coalesce({count('text', p.regex)}, 0)" for p in C.PERSONAL}
SCORE = " + ".join(f"{PERSONAL[p.name]} * {p.weight}" for p in C.PERSONAL)
TOTAL = " + ".join(PERSONAL.values())
LEVEL = "CASE WHEN risk_score <= 0 THEN 'LOW' WHEN risk_score <= 5 THEN 'MEDIUM' WHEN risk_score <= 15 THEN 'HIGH' ELSE 'CRITICAL' END"
RISK = f"SELECT doc_id, CAST({SCORE} AS BIGINT) AS risk_score, CAST({TOTAL} AS BIGINT) AS pii_count FROM documents"

NOTES = """
    SELECT event_id AS doc_id, event_type, ts, CASE event_type
        WHEN 'click' THEN 'Allow user dev' || user_id || ' to access. Policy: Allow. Username: user' || user_id || ' logged in at 2024-0' || (event_id % 9 + 1) || '-1' || (user_id % 10) || ' 10:00:0' || (event_id % 10) || '. Assume role granted by trust policy.'
        WHEN 'error' THEN 'Alert: high severity intrusion detected. Src ip: 10.0.' || (user_id % 256) || '.1 port ' || (event_id % 70000) || '. Malware blocked, rule id: ' || event_id || '! Snort alert.'
        WHEN 'purchase' THEN 'PCI compliance review: audit finding. CVE-2023-' || lpad(CAST(event_id AS VARCHAR), 6, '1') || ' is a critical vulnerability; patch required. Cvss: 9.8. Mail a' || user_id || '@corp.example.com.'
        WHEN 'signup' THEN 'Deny TCP port 22. Firewall rule: inbound traffic from https hosts. Source ip: 10.0.' || (user_id % 256) || '.1. TLS encryption; cipher: AES-256. Log in /var/log/app' || user_id || '/x.log.'
        ELSE 'Nothing notable in lobby ' || user_id || '.' END AS text
    FROM events
"""
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def literal_hits(name: str) -> str:
    """Places of a name in ``a``, the letters of the lower-cased text."""
    n = len(name)
    same = " AND ".join(f"a[i + {k}] = {q(c)}" for k, c in enumerate(name))
    return f"list_transform(list_filter(range(1, greatest(1, len(a) - {n - 2})), lambda i: {same}), lambda p: {{'text': substring(text, p, {n}), 's': CAST(p - 1 AS BIGINT)}})"


def consuming(regex: str) -> str:
    """What is looked ahead for is consumed; it holds no digit, so as many matches are found."""
    return regex.replace("(?=", "(?:")


LETTERS = "(SELECT *, string_split(lower(text), '') AS a FROM {})"


def fold(found: list[tuple[str, str]], mode: str, source: str, spaced: bool) -> str:
    """The fold over replacements by descending start, as a reduction of a list: doc_id, text, t. ``found``: hits and placeholder."""
    parts = []
    for k, (some, placeholder) in enumerate(found):
        by = {"replace": q(placeholder), "mask": "repeat('*', length(x.text))", "remove": "''"}[mode]
        parts.append(f"list_transform({some}, lambda x, j: {{'down': -x.s, 'k': {k}, 'j': j, 's': x.s, 'e': x.s + length(x.text), 'by': {by}, 't': ''}})")
    alnum = r"regexp_full_match({}, '[\p{{L}}\p{{N}}]')"
    pre = f"CASE WHEN x.s > 0 AND {alnum.format('substring(acc.t, x.s, 1)')} THEN ' ' ELSE '' END" if spaced else "''"
    post = f"CASE WHEN {alnum.format('substring(acc.t, x.e + 1, 1)')} THEN ' ' ELSE '' END" if spaced else "''"
    step = f"{{'down': x.down, 'k': x.k, 'j': x.j, 's': x.s, 'e': x.e, 'by': x.by, 't': substring(acc.t, 1, x.s) || {pre} || x.by || {post} || substring(acc.t, x.e + 1)}}"
    return f"""
        SELECT doc_id, text, list_reduce(list_prepend({{'down': CAST(0 AS BIGINT), 'k': 0, 'j': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'e': CAST(0 AS BIGINT), 'by': '', 't': text}}, r), lambda acc, x: {step}).t AS t
        FROM (SELECT doc_id, text, list_sort({' || '.join(parts)}) AS r FROM {source})
    """


PERSONAL_HITS = [(hits("text", p.regex, True), p.replacement) for p in C.PERSONAL]
CLIENT_HITS = [(literal_hits(n), "[CLIENT_NAME]") for n in sorted(n.lower() for n in NAMES)]
SPECIAL_HITS = [(hits("text", p.regex, False), p.replacement) for p in C.SPECIALIZED if p.name != "port_range"]
SQUEEZED = f"trim(regexp_replace(t, '{SPACE}+', ' ', 'g'))"


def redacted(mode: str) -> str:
    return f"SELECT doc_id, {SQUEEZED} AS cleaned FROM ({fold(PERSONAL_HITS, mode, 'documents', True)})"


# ---- topics of notes

TOPIC_PARTS = []
for _position, _c in enumerate(C.CATEGORIES):
    for _k, _r in enumerate(_c.patterns):
        TOPIC_PARTS.append(f"SELECT doc_id, text, {q(_c.name)} AS category, {_position} AS cpos, {_k} AS pattern, unnest({hits('text', _r, True)}) AS h FROM notes")


WORD = r"[\p{L}\p{N}_]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


HITS = f"""
    notes AS (@NOTES@),
    phits AS (SELECT doc_id, text, category, cpos, CAST(pattern AS BIGINT) AS pattern, {strip('h.text')} AS match, h.s AS start_at, h.s + length(h.text) AS end_at FROM ({' UNION ALL '.join(TOPIC_PARTS)})),
    sents AS (SELECT doc_id, text, s FROM (SELECT doc_id, text, {strip("unnest(regexp_extract_all(text, '[^.!?]+[.!?]*'))")} AS s FROM notes) WHERE s <> ''),
    words(category, cpos, kpos, keyword) AS (VALUES {', '.join(f'({q(c.name)}, {i}, {j}, {q(k)})' for i, c in enumerate(C.CATEGORIES) for j, k in enumerate(c.keywords))}),
    khits AS (SELECT doc_id, category, cpos, kpos, keyword, s AS sentence, CAST(instr(text, s) - 1 + instr(lower(s), keyword) - 1 AS BIGINT) AS start_at FROM sents JOIN words ON contains(lower(s), keyword)),
    cats(category, cpos, weight, called) AS (VALUES {', '.join(f'({q(c.name)}, {i}, {c.weight}, {q(c.description)})' for i, c in enumerate(C.CATEGORIES))}),
    counts AS (
        SELECT n.doc_id, c.category, c.cpos, c.weight, c.called, coalesce(p.n, 0) AS np, coalesce(k.n, 0) AS nk,
            len(regexp_extract_all(n.text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS nw
        FROM notes n CROSS JOIN cats c
        LEFT JOIN (SELECT doc_id, category, count(*) AS n FROM phits GROUP BY ALL) p ON p.doc_id = n.doc_id AND p.category = c.category
        LEFT JOIN (SELECT doc_id, category, count(*) AS n FROM khits GROUP BY ALL) k ON k.doc_id = n.doc_id AND k.category = c.category
    ),
    topics AS (
        SELECT *, np + nk AS finding_count, CASE WHEN np + nk = 0 THEN 0.0::DOUBLE ELSE floor((least((np + nk) / 10.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE
            + least(CASE WHEN nw > 0 THEN nk::DOUBLE / nw ELSE 0.0::DOUBLE END * 100, 1.0::DOUBLE) * 0.3::DOUBLE + least(np / 5.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE) * 1000 + 0.5::DOUBLE) / 1000 END AS confidence
        FROM counts
    )
"""
DOCUMENT_HITS = HITS.replace("@NOTES@", "SELECT doc_id, text FROM documents")
HITS = HITS.replace("@NOTES@", NOTES)
TITLE = "CASE category " + " ".join(f"WHEN {q(c.name)} THEN {q(c.name.replace('_', ' ').title())}" for c in C.CATEGORIES) + " END"
KEYS = f"""
    lines AS (
        SELECT p.doc_id, p.cpos, row_number() OVER (PARTITION BY p.doc_id, p.cpos ORDER BY pattern, start_at) AS r, {TITLE.replace('CASE category', 'CASE p.category')} || ': ' || match AS line, 3 AS most
        FROM phits p JOIN topics t ON t.doc_id = p.doc_id AND t.category = p.category WHERE t.confidence > 0.3
        UNION ALL
        SELECT doc_id, cpos, row_number() OVER (PARTITION BY doc_id, cpos ORDER BY sentence) AS r, {TITLE} || ': ' || substring(sentence, 1, 100) || '...', 2
        FROM (SELECT DISTINCT k.doc_id, k.cpos, k.category, k.sentence FROM khits k JOIN topics t ON t.doc_id = k.doc_id AND t.category = k.category WHERE t.confidence > 0.3 AND t.np = 0)
    ),
    ranked AS (SELECT doc_id, line, min(cpos * 10 + r) AS o FROM lines WHERE r <= most GROUP BY doc_id, line)
"""
ADVICE = ", ".join(f"({q(c.name)}, {q(a)})" for c in C.CATEGORIES for a in c.recommendations)

RESULTS = f"""
    r AS (
        SELECT printf('file%08d', event_id) AS file_name, CASE WHEN event_id % 10 <> 0 THEN event_type END AS file_type, 'About ' || event_type AS file_description,
            '2024-01-01T00:00:00' AS processing_timestamp, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 <> 0 END AS success,
            (event_id * 37) % 15000 AS text_length, CAST(event_id % 60 AS DOUBLE) AS processing_time,
            CASE WHEN event_id % 5 <> 0 THEN ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][user_id % 4 + 1] END AS risk_level,
            CASE WHEN event_id % 4 <> 0 THEN user_id % 9 END AS pii_count,
            CASE WHEN event_id % 6 <> 0 THEN [{{'t': 'email', 'n': user_id % 3}}, {{'t': 'phone', 'n': event_id % 2}}] END AS pii_types,
            user_id % 5 AS total_findings, (user_id % 8) / 8.0::DOUBLE AS confidence_score,
            [{', '.join(q(c.name) for c in C.CATEGORIES)}][user_id % 5 + 1 : user_id % 5 + event_id % 3] AS categories_found,
            ['Finding ' || (user_id % 11), 'Other ' || (event_id % 13)] AS key_findings, ['Do ' || (user_id % 23)] AS recommendations, user_id, event_id
        FROM events
    )
"""

BOX = "CAST(l_partkey % 97 AS BIGINT) AS x, CAST(l_suppkey % 53 AS BIGINT) AS y, CAST(l_partkey % 31 + 5 AS BIGINT) AS w, CAST(l_suppkey % 17 + 5 AS BIGINT) AS h"
BOXES = f"""
    b AS (SELECT l_orderkey AS image, list({{'x': x, 'y': y, 'w': w, 'h': h, 'confidence': confidence}} ORDER BY l_linenumber, l_partkey, l_suppkey) AS bs
        FROM (SELECT *, ((l_partkey * 7 + l_linenumber) % 1000) / 1000.0::DOUBLE AS confidence, {BOX} FROM lineitem) GROUP BY l_orderkey)
"""
MEET = "greatest(0, least(k.x + k.w, x[1].x + x[1].w) - greatest(k.x, x[1].x)) * greatest(0, least(k.y + k.h, x[1].y + x[1].h) - greatest(k.y, x[1].y))"
IOU = f"({MEET})::DOUBLE / (k.w * k.h + x[1].w * x[1].h - ({MEET}))"
CLOSE = "abs((x[1][1].x + x[1][1].w / 2.0) - (m.x + m.w / 2.0)) < greatest(x[1][1].w, m.w) AND abs((x[1][1].y + x[1][1].h / 2.0) - (m.y + m.h / 2.0)) < greatest(x[1][1].h, m.h)"
FITS = f"list_position(list_transform(acc, lambda g: len(list_filter(g, lambda m: {CLOSE})) > 0), true)"
WORDS = """
    w AS (
        SELECT o AS image, k AS seq, CAST(floor((k + o % 3) / 2) AS BIGINT) AS block_num, CASE WHEN (o + k) % 5 = 0 THEN ' ' ELSE 'w' || (o * k) END AS text,
            CAST((o * 7 + k * 13) % 101 - 1 AS DOUBLE) AS conf, k * 12 + (o % 2) * k * 20 AS top, ((o + k) % 4) * 10 + 10 AS height
        FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS k FROM lineitem)
    )
"""
BLOCKS = f"""
    {WORDS},
    v AS (SELECT *, CASE WHEN block_num <> lag(block_num) OVER (PARTITION BY image ORDER BY seq) THEN 1 ELSE 0 END AS new FROM w WHERE trim(text) <> '' AND conf > 0),
    b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY image ORDER BY seq) AS BIGINT) AS block FROM v),
    blocks AS (SELECT image, block, string_agg(text, ' ' ORDER BY seq) AS text, avg(conf) AS confidence, count(*) AS words FROM b GROUP BY ALL)
"""
SHEET = """
    s AS (
        SELECT c_custkey, c_name AS full_name, CASE WHEN c_nationkey > 5 THEN c_name || '@x.org' END AS email,
            CASE WHEN c_nationkey % 2 = 0 THEN 'call 555-123-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' now' ELSE c_mktsegment END AS note
        FROM customer
    )
"""


def region(text: str, prefix: str = "") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p.regex)}) THEN {q(prefix + p.name)}" for p in C.REGIONS) + " END"


def any_of(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def entity(kind: str, source: str) -> str:
    _, regex, group, case = next(e for e in C.STRUCTURED if e[0] == kind)
    origin = {"documents": "SELECT doc_id, text FROM documents", "pages": "SELECT page_id AS doc_id, url AS text FROM pages", "notes": f"SELECT doc_id, text FROM ({NOTES})"}[source]
    value = f"regexp_extract(h.text, {rx(regex, not case)}, {group})" if group else "h.text"
    value = {"ports": f"CAST(CAST({value} AS INTEGER) AS VARCHAR)", "protocols": f"upper({value})"}.get(kind, value)
    keep = f"WHERE CAST(regexp_extract(h.text, {rx(regex, not case)}, 1) AS INTEGER) BETWEEN 1 AND 65535" if kind == "ports" else ""
    return f"""
        WITH o AS ({origin}), m AS (SELECT doc_id, text AS whole, unnest({hits('text', regex, not case)}) AS h FROM o)
        SELECT doc_id, {value} AS value, {around('whole', 'h.s', '(h.s + length(h.text))', 50)} AS context, h.s AS start_at FROM m {keep}
    """


ENTITY_SOURCES = {"ip_addresses": "documents", "ports": "documents", "protocols": "notes", "domains": "pages", "file_paths": "pages", "usernames": "notes", "timestamps": "notes"}
CLEAN_NOTE = "CASE WHEN note LIKE 'call 555-123-%' THEN 'call [PHONE] now' ELSE note END"

SUMMARY = f"""
        WITH @HITS@,
        d AS (SELECT doc_id, coalesce(string_agg(category, ',' ORDER BY cpos) FILTER (WHERE finding_count > 0), '') AS categories, CAST(sum(finding_count) AS BIGINT) AS total_findings,
            list_sum(list_transform(list(confidence ORDER BY cpos), lambda x, i: x * [{', '.join(str(c.weight) for c in C.CATEGORIES)}][i])) AS weighted,
            list(called ORDER BY cpos) FILTER (WHERE confidence > 0.5) AS sure FROM topics GROUP BY doc_id)
        SELECT doc_id, categories, total_findings, CAST(floor(weighted * 1000 + 0.5) AS BIGINT) AS confidence_thousandths,
            CASE WHEN categories = '' THEN 'No significant security content detected'
                WHEN coalesce(len(sure), 0) = 0 THEN 'Contains security-related content (' || replace(categories, ',', ', ') || ')'
                WHEN len(sure) = 1 THEN 'Contains ' || sure[1]
                WHEN len(sure) = 2 THEN 'Contains ' || sure[1] || ' and ' || sure[2]
                ELSE 'Contains ' || array_to_string(sure[1:len(sure)-1], ', ') || ', and ' || sure[len(sure)] END AS description
        FROM d
    """



def normalized(source: str) -> str:
    """RE2 has no look-around: a replacement between word characters runs twice, for those that two of them share."""
    twice = lambda t, mark, by: f"regexp_replace(regexp_replace({t}, '({WORD}){mark}({WORD})', '{by}', 'g'), '({WORD}){mark}({WORD})', '{by}', 'g')"
    t = twice(twice(r"regexp_replace(text, '[\r\n\t\f\v]+', ' ', 'g')", "~", r"\1\2"), "-", r"\1 \2")
    spaced = rf"regexp_replace(regexp_replace({t}, '{SPACE}+', ' ', 'g'), '{SPACE}*([.,!?]){SPACE}*', '\1 ', 'g')"
    return f"SELECT doc_id, {strip(spaced)} AS text FROM ({source})"


def post_processed(t: str) -> str:
    boxed = rf"regexp_replace({t}, '{SPACE}*\[([^\]]+)\]{SPACE}*', ' [\1] ', 'g')"
    stops = rf"regexp_replace(regexp_replace({boxed}, '{SPACE}+', ' ', 'g'), '\.([\p{{L}}\p{{N}}_])', '. \1', 'g')"
    return strip(stops)


ORACLE = {
    "pii_type_counts": "SELECT pii_type, CAST(coalesce(n, 0) AS BIGINT) AS matches FROM (SELECT " + ", ".join(f"sum({e}) AS {n}" for n, e in PERSONAL.items()) + " FROM documents) UNPIVOT INCLUDE NULLS (n FOR pii_type IN (" + ", ".join(PERSONAL) + "))",
    "pii_doc_counts": "SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in PERSONAL.items()) + " FROM documents",
    "pii_matches": "SELECT doc_id, pii_type, h.text AS match, h.s AS start_at, h.s + length(h.text) AS end_at FROM (" + flat_hits("documents", "doc_id", "pii_type", [(p.name, p.regex, True) for p in C.PERSONAL]) + ")",
    "dictionary_scan": " UNION ALL ".join(
        f"SELECT doc_id, {q(n.lower())} AS client_name, h.text AS match, h.s AS start_at, h.s + {len(n)} AS end_at FROM (SELECT doc_id, unnest({literal_hits(n.lower())}) AS h FROM {LETTERS.format('documents')} WHERE contains(lower(text), {q(n.lower())}))"
        for n in NAMES
    ),
    "pii_risk_scores": f"SELECT doc_id, risk_score, pii_count, {LEVEL} AS risk_level FROM ({RISK})",
    "pii_risk_histogram": f"SELECT l.risk_level, count(r.doc_id) AS files FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) l(risk_level) LEFT JOIN (SELECT doc_id, {LEVEL} AS risk_level FROM ({RISK})) r USING (risk_level) GROUP BY l.risk_level",
    "pii_recommendations": f"WITH r AS (SELECT doc_id, text, CAST({SCORE} AS BIGINT) AS risk_score FROM documents) SELECT doc_id, array_to_string(list_filter(CASE {LEVEL} "
    + " ".join(f"WHEN {q(k)} THEN [{', '.join(map(q, v))}]" for k, v in C.RISK_ADVICE.items())
    + " END || ["
    + ", ".join(f"CASE WHEN {PERSONAL[n]} > 0 THEN {q(line)} END" for n, line in C.FOUND_ADVICE)
    + "], lambda x: x IS NOT NULL), ' | ') AS recommendations FROM r",
    "redact_replace": redacted("replace"),
    "redact_mask": redacted("mask"),
    "redact_remove": redacted("remove"),
    "redact_report": f"""
        WITH f AS ({fold(PERSONAL_HITS + CLIENT_HITS, "replace", LETTERS.format("documents"), True)}),
        g AS (SELECT doc_id, text, {SQUEEZED} AS cleaned, CAST({TOTAL} AS BIGINT) AS total_patterns, {" + ".join(f"len({h})" for h, _ in CLIENT_HITS)} AS total_client_names, CAST({SCORE} AS BIGINT) AS patterns_score FROM {LETTERS.format('f')}),
        h AS (SELECT *, patterns_score + 4 * total_client_names AS risk_score FROM g)
        SELECT doc_id, length(text) AS text_length, total_patterns, CAST(total_client_names AS BIGINT) AS total_client_names, {LEVEL} AS risk_level, CAST(risk_score AS BIGINT) AS risk_score,
            CASE WHEN length(cleaned) > 500 THEN substring(cleaned, 1, 500) || '...' ELSE cleaned END AS cleaned_preview, risk_score > 5 AS requires_cleaning FROM h
    """,
    "redact_specialized": f"SELECT doc_id, t AS cleaned FROM ({fold(SPECIAL_HITS, 'replace', '(' + NOTES + ')', False)})",
    "specialized_counts": "WITH o AS (SELECT text FROM documents UNION ALL SELECT text FROM (" + NOTES + ")) SELECT name, CAST(n AS BIGINT) AS matches FROM (SELECT " + ", ".join(f"sum({count('text', consuming(p.regex), False)}) AS {p.name}" for p in C.SPECIALIZED) + " FROM o) UNPIVOT INCLUDE NULLS (n FOR name IN (" + ", ".join(p.name for p in C.SPECIALIZED) + "))",
    "structured_clean": f"WITH {SHEET} SELECT c_custkey, '[PERSON]' AS full_name, '[EMAIL]' AS email, {CLEAN_NOTE} AS note FROM s",
    "structured_statistics": f"WITH {SHEET} SELECT count(*) * 4 AS total_fields, CAST(sum(2 + CASE WHEN note LIKE 'call 5%' THEN 1 ELSE 0 END) AS BIGINT) AS fields_with_pii, CAST(sum(2 + CASE WHEN note LIKE 'call 5%' THEN 1 ELSE 0 END) AS BIGINT) AS pii_instances FROM s",
    "sheet_redacted": f"WITH {SHEET} SELECT c_custkey, CASE WHEN full_name IS NOT NULL THEN '[REDACTED NAME]' END AS full_name, CASE WHEN email IS NOT NULL THEN '[REDACTED EMAIL]' END AS email, note FROM s",
    "sheet_statistics": f"WITH {SHEET} SELECT 'Employee Full Name' AS column_name, 'PERSON' AS pii_type, count(full_name) AS cells FROM s UNION ALL SELECT 'Supervisor Email', 'email', count(email) FROM s",
    "sheet_profile": f"WITH {SHEET}, n AS (SELECT count(*) AS t, count(*) - count(c_custkey) AS a, count(*) - count(full_name) AS b, count(*) - count(email) AS c, count(*) - count(note) AS d FROM s) SELECT 'c_custkey' AS column_name, 0::BIGINT AS position, t AS total_rows, a AS null_count, false AS potentially_sensitive FROM n UNION ALL SELECT 'Employee Full Name', 1, t, b, true FROM n UNION ALL SELECT 'Supervisor Email', 2, t, c, true FROM n UNION ALL SELECT 'note', 3, t, d, false FROM n",
    "row_text": f"WITH {SHEET} SELECT c_custkey, concat_ws(' | ', CAST(c_custkey AS VARCHAR), full_name, email, note) AS line FROM s",
    "cell_lines": f"WITH {SHEET} SELECT c_custkey, 0::BIGINT AS position, 'Employee Full Name: ' || full_name AS line FROM s WHERE full_name IS NOT NULL UNION ALL SELECT c_custkey, 1, 'Supervisor Email: ' || email FROM s WHERE email IS NOT NULL UNION ALL SELECT c_custkey, 2, 'note: ' || note FROM s WHERE note IS NOT NULL",
    "nested_clean": "SELECT event_id, '[AWS_RESOURCE]' AS who, '[RESOURCE_NAME],plain' AS tags FROM events",
    "text_normalized": normalized("SELECT doc_id, text FROM documents"),
    "text_post_processed": f"SELECT doc_id, {post_processed('t')} AS text FROM (SELECT doc_id, trim(regexp_replace(replace(text, '|', '[BAR]'), '{SPACE}+', ' ', 'g')) AS t FROM documents)",
    "clean_lines": f"SELECT doc_id, {post_processed('t')} AS line FROM (SELECT doc_id, {SQUEEZED} AS t FROM ({fold(PERSONAL_HITS, 'replace', '(' + normalized('SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents') + ')', True)}))",
    "label_risk": f"SELECT quality, count(*) AS docs, CAST(sum(pii_count) AS BIGINT) AS pii_items, max(risk_score) AS largest_score FROM ({RISK}) JOIN labels USING (doc_id) GROUP BY quality",
    **{f"extract_{kind}": entity(kind, source) for kind, source in ENTITY_SOURCES.items()},
    "category_pattern_hits": f"WITH {HITS} SELECT doc_id, category, pattern, match, {around('text', 'start_at', 'end_at', 100)} AS context, start_at FROM phits",
    "keyword_hits": f"WITH {HITS} SELECT doc_id, category, keyword, sentence, start_at FROM khits",
    "category_confidence": f"WITH {HITS} SELECT doc_id, category, finding_count, confidence FROM topics",
    "security_summary": SUMMARY.replace("@HITS@", HITS),
    "documents_security": f"SELECT doc_id, categories, total_findings, description FROM ({SUMMARY.replace('@HITS@', DOCUMENT_HITS)})",
    "key_findings": f"WITH {HITS}, {KEYS} SELECT doc_id, p - 1 AS position, line AS finding FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS p FROM ranked) WHERE p <= 10",
    "security_recommendations": f"""
        WITH {HITS}, advice(category, a) AS (VALUES {ADVICE})
        SELECT DISTINCT doc_id, a AS recommendation FROM topics JOIN advice USING (category) WHERE confidence > 0.5
        UNION SELECT doc_id, unnest([{', '.join(map(q, C.GENERAL_RECOMMENDATIONS))}]) FROM topics GROUP BY doc_id HAVING count(*) FILTER (WHERE confidence > 0.3) > 2
    """,
    "best_text": f"""
        WITH c AS (SELECT doc_id, unnest([{strip('text')}, {strip("regexp_replace(text, '[a-z]', ' ', 'g')")}]) AS t, unnest([1, 2]) AS i FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS ws FROM c WHERE t <> ''),
        s AS (SELECT *, len(ws) + len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}\\s]'))::DOUBLE / length(t) + len(list_filter(ws, lambda x: length(x) > 1)) AS score FROM w)
        SELECT d.doc_id, coalesce(b.t, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM s) b ON b.doc_id = d.doc_id AND b.r = 1
    """,
    "region_types": f"WITH n AS ({NOTES}), t AS (SELECT doc_id, {region('text')} AS type FROM n) SELECT doc_id, type, CASE WHEN type IS NOT NULL THEN 95.0::DOUBLE END AS confidence FROM t",
    "region_context": f"""
        WITH c AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'secret ' || text ELSE text END AS text FROM conversations),
        n AS (SELECT a.conv_id, a.turn, any_value(a.text) AS text, string_agg(b.text, ' ' ORDER BY b.turn) AS others FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY a.conv_id, a.turn),
        t AS (SELECT conv_id, turn, {region('text')} AS direct, CASE WHEN others IS NOT NULL THEN {region("(text || ' ' || others)", 'contextual_')} END AS near FROM n)
        SELECT conv_id, turn, coalesce(direct, near) AS type, CASE WHEN direct IS NOT NULL THEN 95.0::DOUBLE WHEN near IS NOT NULL THEN 85.0::DOUBLE END AS confidence FROM t
    """,
    "content_types": f"""
        SELECT doc_id, CASE WHEN regexp_matches(text, '\\d{{2}}:\\d{{2}}:\\d{{2}}') OR regexp_matches(text, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN 'surveillance' WHEN {any_of('text', ('function', 'class', 'def', 'return', 'import'))} THEN 'code' ELSE 'standard' END AS content,
            CASE WHEN {any_of('lower(text)', ('name:', 'date:', 'signature:', 'address:', 'phone:', 'email:'))} THEN 'form' WHEN {any_of('text', ('{', '}', 'function', 'class', 'def', 'return', 'import', 'from'))} THEN 'code' ELSE 'standard' END AS page,
            CASE WHEN {any_of('upper(text)', ('CERTIFICATE', 'CERTIFICATION', 'DIPLOMA'))} THEN 'certificate' WHEN {any_of('text', ('{', '}', 'function', 'class', 'def'))} THEN 'code' ELSE 'default' END AS document
        FROM documents
    """,
    "bbox_bounds": f"SELECT image, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM (SELECT l_orderkey AS image, {BOX} FROM lineitem) GROUP BY image",
    "bbox_nms": f"""
        WITH {BOXES}, k AS (SELECT image, list_reduce(list_transform(list_transform(list_sort(list_transform(bs, lambda b, i: {{'down': -b.confidence, 'i': i, 'b': b}})), lambda s: s.b), lambda b: [b]),
            lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {IOU} > 0.1)) > 0 THEN acc ELSE acc || x END) AS kept FROM b)
        SELECT image, p - 1 AS position, kept[p].x AS x, kept[p].y AS y, kept[p].w AS w, kept[p].h AS h, kept[p].confidence AS confidence FROM (SELECT image, kept, unnest(range(1, len(kept) + 1)) AS p FROM k)
    """,
    "bbox_groups": f"""
        WITH {BOXES}, k AS (SELECT image, list_reduce(list_transform(bs, lambda b: [[b]]), lambda acc, x: CASE WHEN {FITS} IS NULL OR {FITS} = 0 THEN acc || x ELSE list_transform(acc, lambda g, i: CASE WHEN i = {FITS} THEN g || x[1] ELSE g END) END) AS gs FROM b),
        g AS (SELECT image, p - 1 AS position, gs[p] AS g FROM (SELECT image, gs, unnest(range(1, len(gs) + 1)) AS p FROM k))
        SELECT image, position, len(g) AS members, list_min(list_transform(g, lambda b: b.x)) AS x, list_min(list_transform(g, lambda b: b.y)) AS y,
            list_max(list_transform(g, lambda b: b.x + b.w)) - list_min(list_transform(g, lambda b: b.x)) AS w, list_max(list_transform(g, lambda b: b.y + b.h)) - list_min(list_transform(g, lambda b: b.y)) AS h FROM g
    """,
    "bbox_merged": f"""
        WITH {BOXES}, k AS (SELECT image, list_reduce(list_transform(list_sort(list_transform(bs, lambda b, i: {{'at': b.x, 'i': i, 'b': {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}}})), lambda s: [s.b]),
            lambda acc, x: CASE WHEN x[1].x <= acc[-1].x + acc[-1].w + 10 AND x[1].y <= acc[-1].y + acc[-1].h + 10
                THEN acc[1:len(acc) - 1] || [{{'x': acc[-1].x, 'y': acc[-1].y, 'w': greatest(acc[-1].x + acc[-1].w, x[1].x + x[1].w) - acc[-1].x, 'h': greatest(acc[-1].y + acc[-1].h, x[1].y + x[1].h) - acc[-1].y}}] ELSE acc || x END) AS m FROM b)
        SELECT image, p - 1 AS position, m[p].x AS x, m[p].y AS y, m[p].w AS w, m[p].h AS h FROM (SELECT image, m, unnest(range(1, len(m) + 1)) AS p FROM k)
    """,
    "bbox_padded": f"SELECT image, greatest(0, x - px) AS x, greatest(0, y - py) AS y, least(110, x + w + px) - greatest(0, x - px) AS w, least(60, y + h + py) - greatest(0, y - py) AS h FROM (SELECT *, CAST(floor(w * 0.15) AS BIGINT) AS px, CAST(floor(h * 0.15) AS BIGINT) AS py FROM (SELECT l_orderkey AS image, {BOX} FROM lineitem))",
    "ocr_blocks": f"WITH {BLOCKS} SELECT image, block, text, CAST(round(confidence * 1000) AS BIGINT) AS confidence_thousandths, words FROM blocks",
    "ocr_summary": f"WITH {BLOCKS} SELECT image, CAST(sum(words) AS BIGINT) AS word_count, count(*) AS line_count FROM blocks GROUP BY image",
    "ocr_layout": f"""
        WITH {WORDS},
        v AS (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY image ORDER BY seq)) > height THEN 1 ELSE 0 END AS new FROM w WHERE trim(text) <> ''),
        b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY image ORDER BY seq) AS BIGINT) AS block FROM v),
        g AS (SELECT image, block, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS n, arg_min(height, seq) AS first FROM b GROUP BY ALL),
        a AS (SELECT *, lead(first) OVER (PARTITION BY image ORDER BY block) AS after FROM g)
        SELECT image, block, CASE WHEN n = 1 AND after > 30 THEN 'title' WHEN after > 20 THEN 'headers' ELSE 'body' END AS part, text FROM a
    """,
    "ocr_sure_confidence": f"WITH {WORDS} SELECT image, CAST(round(avg(conf) * 1000) AS BIGINT) AS confidence_thousandths FROM w WHERE conf > 60 GROUP BY image",
    "best_candidates": f"WITH {WORDS}, c AS (SELECT *, (image + seq) % 3 = 0 AS is_cli FROM w) SELECT image, text, conf, is_cli FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY is_cli DESC, conf DESC, seq) AS r FROM c) WHERE r = 1",
    "report_overview": f"""
        WITH {RESULTS} SELECT count(*) AS total_files, count(*) FILTER (WHERE coalesce(success, true)) AS successful_processing, count(*) FILTER (WHERE NOT coalesce(success, true)) AS files_with_errors,
            count(*) FILTER (WHERE coalesce(risk_level, 'LOW') IN ('HIGH', 'CRITICAL')) AS high_risk_files, CAST(sum(coalesce(pii_count, 0)) AS BIGINT) AS total_pii_items,
            count(*) FILTER (WHERE total_findings > 0) AS files_with_security_content, CAST(sum(total_findings) AS BIGINT) AS total_findings, avg(confidence_score) AS avg_confidence FROM r
    """,
    "report_file_types": f"WITH {RESULTS} SELECT coalesce(file_type, 'unknown') AS file_type, count(*) AS files FROM r GROUP BY 1",
    "report_risk_histogram": f"WITH {RESULTS} SELECT l.risk_level, count(r.file_name) AS files FROM (VALUES {', '.join(f'({q(x)})' for x in report.LEVELS)}) l(risk_level) LEFT JOIN r ON coalesce(r.risk_level, 'LOW') = l.risk_level GROUP BY 1",
    "report_categories": f"WITH {RESULTS} SELECT category, count(*) AS files FROM (SELECT unnest(categories_found) AS category FROM r) GROUP BY 1",
    "report_category_details": f"WITH {RESULTS}, c AS (SELECT unnest([{', '.join(q(c.name) for c in C.CATEGORIES)}]) AS category, unnest(range(0, 6)) AS i, user_id, event_id FROM r) SELECT category, count(*) AS files, avg(((user_id + i) % 8) / 8.0::DOUBLE) AS avg_confidence, CAST(sum((event_id + i) % 4) AS BIGINT) AS total_findings FROM c GROUP BY 1",
    "report_pii_types": f"WITH {RESULTS} SELECT p.t AS pii_type, CAST(sum(p.n) AS BIGINT) AS total FROM (SELECT unnest(pii_types) AS p FROM r) GROUP BY 1",
    "report_distinct_values": f"WITH {RESULTS} SELECT DISTINCT 'key_findings' AS kind, unnest(key_findings) AS value FROM r UNION SELECT 'security_categories', unnest(categories_found) FROM r UNION SELECT 'pii_types', p.t FROM (SELECT unnest(pii_types) AS p FROM r) UNION SELECT 'high_confidence_findings', unnest(key_findings) FROM r WHERE confidence_score > 0.7",
    "report_recommendations": f"WITH {RESULTS} SELECT recommendation FROM (SELECT DISTINCT unnest(recommendations) AS recommendation FROM r) ORDER BY 1 LIMIT 15",
    "report_sizes": f"WITH {RESULTS} SELECT count(*) FILTER (WHERE text_length < 1000) AS small_files, count(*) FILTER (WHERE text_length >= 1000 AND text_length < 10000) AS medium_files, count(*) FILTER (WHERE text_length >= 10000) AS large_files FROM r",
    "report_times": f"WITH {RESULTS} SELECT sum(processing_time) AS total_time, avg(processing_time) AS average_time, min(processing_time) AS min_time, max(processing_time) AS max_time FROM r",
    "report_csv": f"""
        WITH {RESULTS} SELECT file_name, coalesce(file_type, '') AS file_type, file_description, processing_timestamp, text_length, coalesce(risk_level, '') AS pii_risk_level, coalesce(pii_count, 0) AS pii_items_found,
            confidence_score AS security_confidence, total_findings AS total_security_findings, array_to_string(key_findings, ' | ') AS key_findings, coalesce(array_to_string(categories_found, ', '), '') AS security_categories FROM r
    """,
    "report_pages": f"""
        WITH {RESULTS}, n AS (SELECT *, row_number() OVER (ORDER BY file_name) AS i FROM r)
        SELECT CAST((i - 1) // 8 + 1 AS BIGINT) AS page, CAST((i - 1) % 8 + 1 AS BIGINT) AS row, file_name, coalesce(file_type, 'Unknown') AS file_type, file_description AS description, array_to_string(key_findings, '; ') AS key_findings FROM n
    """,
    "report_bullets": f"WITH {RESULTS} SELECT '• ' || coalesce(file_type, 'unknown') || ': ' || count(*) AS line FROM r GROUP BY file_type",
    "stream_finding_counts": f"""
        WITH n AS ({NOTES}), c AS (SELECT date_trunc('day', ts) AS w, {', '.join(f'{e} AS {k}' for k, e in PERSONAL.items())} FROM n),
        u AS (SELECT w, pii_type, x FROM c UNPIVOT (x FOR pii_type IN ({', '.join(PERSONAL)})))
        SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, pii_type, CAST(sum(x) AS BIGINT) AS n FROM u WHERE x > 0 GROUP BY ALL
    """,
}
