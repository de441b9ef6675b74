"""DuckDB statements with the results of the queries that SQL can express."""

from __future__ import annotations

from .decontam import BAND, LEAST, REPEATS, TOKEN, WINDOW

#: The pattern without possessive repeats, which this engine doesn't need.
_TOKEN = TOKEN.replace("*+", "*")
_SLOT = "IN ('#', '#u', '@')"


def _shape(texts: str) -> str:
    """(id, s, c, v): the templates of the texts: place, code and own words of each element."""
    return f"""
        SELECT id, s, min(c) AS c, string_agg(w, ' ' ORDER BY t) AS v FROM (
            SELECT id, t, w, c, sum(CASE WHEN c = '@' AND before = '@' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t)::BIGINT - 1 AS s FROM (
                SELECT *, lag(c) OVER (PARTITION BY id ORDER BY t) AS before FROM (
                    SELECT id, t, lower(w) AS w, CASE
                        WHEN regexp_matches(w, '^[0-9]') THEN CASE WHEN regexp_matches(w, '[\\p{{L}}%€$]$') THEN '#u' ELSE '#' END
                        WHEN NOT name THEN lower(w) WHEN name OR lower(w[1]) <> w[1] THEN '@' ELSE lower(w) END AS c
                    FROM (SELECT id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS t FROM {texts}) LEFT JOIN vocabulary ON word = lower(w)
                )
            )
        ) GROUP BY id, s
    """


def _runs(shape: str, n: int) -> str:
    """(id, s, h, literal): runs of n elements."""
    rows = f"PARTITION BY id ORDER BY s ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING"
    return f"SELECT * FROM (SELECT id, s, string_agg(c, ' ') OVER ({rows}) AS h, count(*) OVER ({rows}) AS n, count(*) FILTER (WHERE NOT c {_SLOT}) OVER ({rows}) AS literal FROM {shape}) WHERE n = {n}"


DECONTAMINATION = f"""
    WITH bench AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
    bt AS (SELECT id, item_id, regexp_extract_all(text, '{_TOKEN}') AS words FROM bench),
    docs AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
    dt AS (SELECT id, doc_id, regexp_extract_all(text, '{_TOKEN}') AS words FROM docs),
    vocabulary AS (SELECT lower(w) AS word, bool_and(lower(w[1]) <> w[1]) AS name FROM (SELECT unnest(words) AS w FROM bt) WHERE NOT regexp_matches(w, '^[0-9]') GROUP BY 1),
    bs AS ({_shape('bt')}),
    ds AS ({_shape('dt')}),
    bx AS (SELECT id, generate_subscripts(words, 1) - 1 AS s, lower(unnest(words)) AS c FROM bt),
    dx AS (SELECT id, generate_subscripts(words, 1) - 1 AS s, lower(unnest(words)) AS c FROM dt),
    template AS (SELECT id, s, h FROM ({_runs('bs', WINDOW)}) WHERE literal >= {WINDOW / 2}),
    exact AS (
        {' UNION ALL '.join(f"SELECT id, s, h, {n} AS len FROM ({_runs('bx', n)}) JOIN (SELECT id, len(words) AS size FROM bt) USING (id) WHERE size {'>=' if n == WINDOW else '='} {n}" for n in range(LEAST, WINDOW + 1))}
    ),
    wins AS (
        SELECT * FROM (SELECT id, s, h, {WINDOW} AS len, false AS exact FROM template UNION ALL SELECT id, s, h, len, true FROM exact WHERE id NOT IN (SELECT id FROM template))
        QUALIFY row_number() OVER (PARTITION BY id, h ORDER BY s) <= {REPEATS}
    ),
    cover AS (SELECT DISTINCT id, unnest(range(s, s + len)) AS i FROM wins),
    items AS (SELECT id, any_value(exact) AS exact, any_value(len) AS len, count(*) AS n_windows, any_value(n) AS n FROM wins JOIN (SELECT id, count(*) AS n FROM cover GROUP BY id) USING (id) GROUP BY id),
    met AS (
        SELECT d.id AS doc, w.id AS item, w.s AS ipos, d.s - w.s AS shift FROM ({_runs('ds', WINDOW)}) d JOIN wins w ON d.h = w.h AND NOT w.exact
        {' '.join(f"UNION ALL SELECT d.id, w.id, w.s, d.s - w.s FROM ({_runs('dx', n)}) d JOIN wins w ON d.h = w.h AND w.exact AND w.len = {n}" for n in range(LEAST, WINDOW + 1))}
    ),
    banded AS (SELECT DISTINCT doc, item, ipos, shift, unnest([floor(shift / {BAND}.0), floor(shift / {BAND}.0) - 1]) AS band FROM met),
    best AS (
        SELECT * FROM (SELECT doc, item, band, count(DISTINCT ipos) AS windows FROM banded GROUP BY ALL) JOIN items ON items.id = item
        WHERE windows >= 0.5 * n_windows QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY windows DESC, band) = 1
    ),
    hits AS (SELECT doc, item, ipos, shift, len, exact FROM best JOIN banded USING (doc, item, band)),
    got AS (
        SELECT doc, item, i, exact, i + shift AS own FROM hits JOIN cover ON cover.id = item AND i >= ipos AND i < ipos + len
        QUALIFY row_number() OVER (PARTITION BY doc, item, i ORDER BY ipos, shift) = 1
    ),
    pairs AS (
        SELECT doc, item, bs.v AS a, coalesce(ds.v, '') AS b FROM got JOIN bs ON bs.id = item AND bs.s = i AND bs.c {_SLOT} LEFT JOIN ds ON ds.id = doc AND ds.s = own WHERE NOT exact
    ),
    steady AS (
        SELECT doc, item, sum(most) / sum(n) AS steady FROM (SELECT doc, item, a, max(n) AS most, sum(n) AS n FROM (SELECT doc, item, a, b, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY ALL) GROUP BY ALL
    ),
    scored AS (
        SELECT best.*, (SELECT first(shift ORDER BY ipos, shift) FROM hits WHERE hits.doc = best.doc AND hits.item = best.item) AS first_token,
            windows::DOUBLE / n_windows AS coverage, same::DOUBLE / n AS agreement, coalesce(steady::DOUBLE, 1.0::DOUBLE) AS consistency
        FROM best JOIN (SELECT doc, item, count(*) AS same FROM got GROUP BY ALL) USING (doc, item) LEFT JOIN steady USING (doc, item)
    )
    SELECT doc_id, item_id, first_token::BIGINT AS first_token, windows, coverage, agreement, consistency
    FROM scored JOIN docs ON docs.id = doc JOIN bench ON bench.id = item WHERE agreement >= 0.6 AND consistency >= 0.75
    QUALIFY row_number() OVER (PARTITION BY doc, item_id ORDER BY coverage DESC, agreement DESC, consistency DESC, first_token, windows DESC) = 1
"""

ORACLE = {
    "op3_decontamination": DECONTAMINATION,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY body, doc_id) = 1 AS kept, sha256(body) AS text_sha256
        FROM d JOIN g USING (body)
    """,
    "op7_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        s AS (
            SELECT *, length('<|turn|><|text|><|end|>') + length(role) + length(text)
                + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS size
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(size) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id
    """,
}
