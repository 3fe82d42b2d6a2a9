"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from lattica.llm.secrets import ACCESS, ASSIGN, HEX

#: Words of a text, as the operators cut them.
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _runs(words: str, k: int) -> str:
    """Distinct runs of k words of a list; the whole list as one if it is shorter, none of an empty one."""
    many = f"list_distinct(list_transform(generate_series(1, len({words}) - {k - 1}), lambda i: array_to_string({words}[i:i + {k - 1}], ' ')))"
    return f"CASE WHEN len({words}) >= {k} THEN {many} WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


def _crc_step(crc: str, byte: str) -> str:
    """crc32 (reflected, 0xEDB88320) after one more byte, bit by bit."""
    out = f"xor({crc}, {byte})"
    for _ in range(8):
        out = f"list_transform([{out}], lambda z: xor(z >> 1, CAST(3988292384 AS UBIGINT) * (z & 1)))[1]"
    return out


def _matches(kind: int, pattern: str, value: int = 0) -> str:
    """Texts of all matches, of a group of theirs, and of what is between matches."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT doc_id, {kind} AS kind, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {value}) AS vals, regexp_split_to_array(t, {p}) AS gaps FROM d"


WARC = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
    ), t AS (SELECT body, max(page_id) AS top, count(*) AS c FROM p WHERE n >= 1000 GROUP BY body)
    SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
        CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM p.page_id THEN top END AS refers_to,
        CAST(NULL AS VARCHAR) AS problem
    FROM p LEFT JOIN t ON p.body = t.body
"""

SECRET_BASE = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({_matches(0, ASSIGN, 2)} UNION ALL {_matches(1, ACCESS)} UNION ALL {_matches(2, HEX)}),
    s AS (
        SELECT doc_id, kind, len(vals[i]) AS n, len(hits[i]) AS size,
            list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0) AS pos
        FROM m, LATERAL (SELECT unnest(generate_series(1, len(hits))) AS i) WHERE len(hits) > 0
    ), f AS (SELECT doc_id, kind, CAST(pos AS BIGINT) AS pos, CAST(pos + size AS BIGINT) AS until FROM s WHERE kind > 0 OR n >= 6),
    a AS (
        SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
            string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || pos || ':' || until, ',' ORDER BY pos, kind) AS listed
        FROM f GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256
    FROM d LEFT JOIN a USING (doc_id)
"""

NEAR_DEDUP = f"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text=f"coalesce({_SMALL}, '')")} AS words FROM documents),
    s AS MATERIALIZED (SELECT doc_id, {_runs("words", 3)} AS runs FROM w),
    e AS MATERIALIZED (SELECT doc_id, unnest(runs) AS run FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.runs) + len(y.runs) - c)),
    steps AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach AS (SELECT doc_id AS v, doc_id AS r FROM s UNION SELECT b, r FROM reach JOIN steps ON a = v)
    SELECT doc_id, CAST(len(runs) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept
    FROM s JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) ON v = doc_id
"""

FINGERPRINT_LIKENESS = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), (SELECT arg_min(t, doc_id) FROM d)) AS f, len(t) // 4 AS cut FROM d),
    x AS (SELECT doc_id, t, f, t[1:len(t) - cut] || f[1:cut] AS edited FROM n),
    w AS (SELECT *, {_WORDS.format(text="lower(t)")} AS wt, {_WORDS.format(text="lower(f)")} AS wf, {_WORDS.format(text="lower(edited)")} AS we FROM x),
    r AS (SELECT doc_id, len(t) AS n_chars, sha256(edited) AS edited_sha256, {_runs("wt", 5)} AS a, {_runs("we", 5)} AS b, {_runs("wf", 5)} AS c FROM w)
    SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, CAST(len(a) AS BIGINT) AS n_shingles, CAST(len(b) AS BIGINT) AS edited_shingles, CAST(len(c) AS BIGINT) AS next_shingles,
        CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END AS near_edited,
        CASE WHEN least(len(a), len(c)) > 0 THEN len(list_intersect(a, c)) / least(len(a), len(c)) WHEN len(a) = len(c) THEN 1.0 ELSE 0.0 END AS near_next
    FROM r
"""

SUBSTRING_DEDUP = f"""
    WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
    s AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS own FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 34)) AS i) WHERE len(words) >= 35),
    r AS MATERIALIZED (SELECT doc_id, i FROM s WHERE own IN (SELECT own FROM s GROUP BY own HAVING count(*) > 1)),
    p AS (SELECT doc_id, i, words[i] AS word FROM w, LATERAL (SELECT unnest(generate_series(1, len(words))) AS i) WHERE len(words) > 0),
    c AS (SELECT p.doc_id, p.i, p.word, max(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
    k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

PERIODIC_RUNS = f"""
    WITH d AS MATERIALIZED (
        SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words,
            list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
                lambda crc, b: {_crc_step("crc", "b")}) AS crc
        FROM documents
    ), c AS (SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n, CAST(xor(crc, CAST(4294967295 AS UBIGINT)) AS BIGINT) AS h FROM d),
    g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM c),
    w AS MATERIALIZED (
        SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(generate_series(0, n - 1),
            lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE words END AS words
        FROM g
    ), p AS MATERIALIZED (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i, len(words) AS n FROM w),
    e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
    r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
    t AS (
        SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS top,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
        FROM r GROUP BY doc_id
    ), k AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND p.i >= r.start + r.period AND p.i < r.start + r.length) GROUP BY doc_id
    )
    SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period,
        CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM w LEFT JOIN t ON t.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""


def _lloyd(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd's rounds, one after another: x are the components of all kept vectors' parts, c0, c1, ... those of the codebooks."""
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, (nr - 1) // (n // {parts}) AS part, (nr - 1) % (n // {parts}) AS pos, CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) AS e FROM (SELECT vec_id, len(v) AS n, unnest(v) AS e, generate_subscripts(v, 1) AS nr FROM k))",
        f"c0 AS MATERIALIZED (SELECT part, entry, pos, e AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (SELECT vec_id, x.part, entry, CAST(sum((e - c) * (e - c)) AS BIGINT) AS d FROM x JOIN c{i} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL) GROUP BY ALL)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT x.part, best.entry AS entry, pos, CAST(floor_div(sum(e), count(*)) AS BIGINT) AS c FROM x JOIN a{i} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (part, entry, pos))")
    # DuckDB's // cuts towards zero
    told = "WITH " + ", ".join(steps).replace("floor_div(sum(e), count(*))", "(sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*)")
    return f"""{told},
    o AS (SELECT vec_id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
    b AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), b
    """


VECTOR_CODES = _lloyd()

LICENSE_BASE = """
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
    f AS (
        SELECT doc_id, i - 1 AS place, label FROM w, LATERAL (SELECT unnest(generate_series(1, len(words))) AS i), (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) p(phrase, label)
        WHERE words[i:i + len(phrase) - 1] = phrase
    ), t AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
    FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""
