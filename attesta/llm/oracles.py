"""DuckDB SQL for the queries that SQL can express in full."""

import re

from attesta.llm.chat_format import BEGIN, CONTROLS, END, ESC, TEXT, TURN

_CONTROLS = "|".join(re.escape(c).replace("/", "[/]") for c in sorted(CONTROLS, key=len, reverse=True)).replace("'", "''")
WORDS = r"[^\x20\x09-\x0D]+"
TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN strlen(html) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(html) >= 100 AND page_id > first THEN first END AS refers_to
        FROM (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    """,
    "op9_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERMS}') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERMS}') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, win, len(win) AS k FROM (
            SELECT item_id, unnest([w[a : a + least(10, len(w)) - 1] FOR a IN range(1, len(w) - least(10, len(w)) + 2)]) AS win FROM b WHERE len(w) > 0)),
        k AS (SELECT DISTINCT k FROM i),
        s AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS a, w FROM d, k WHERE len(w) >= k),
        h AS (SELECT s.doc_id, s.a, s.k, i.item_id FROM s JOIN i ON i.k = s.k AND i.win = s.w[s.a : s.a + s.k - 1]),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM h) GROUP BY 1),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op10_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORDS}') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest([w[a : a + least(5, len(w)) - 1] FOR a IN range(1, len(w) - least(5, len(w)) + 2)]) AS g FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY 1) c USING (doc_id)
    """,
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        g AS (SELECT doc_id, a, substr(h, 2 * a + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS a FROM d WHERE n >= 100)),
        r AS (SELECT doc_id, a FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY hash(s), s ORDER BY doc_id, a) AS k FROM g) WHERE k > 1),
        t AS (SELECT doc_id, a, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run
              FROM (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
        u AS (SELECT doc_id, min(a) AS x, max(a) + 100 AS y FROM t GROUP BY doc_id, run),
        v AS (SELECT doc_id, x, y, lag(y, 1, 0) OVER w AS z, lead(x) OVER w AS nxt FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY x)),
        k AS (SELECT doc_id, sum(y - x) AS gone, count(*) AS runs,
                     string_agg(substr(h, 2 * z + 1, 2 * (x - z)) || CASE WHEN nxt IS NULL THEN substr(h, 2 * y + 1) ELSE '' END, '' ORDER BY x) AS kept
              FROM v JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
               sha256(CASE WHEN kept IS NULL THEN raw ELSE unhex(kept) END) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op8_chat_format": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST({len(BEGIN)} + sum({len(TURN + TEXT + END)} + length(role) + length(text) + 2 * len(regexp_extract_all(role || ' ' || text, '{_CONTROLS}'))
                    + length(role || text) - length(replace(role || text, '{ESC}', ''))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op11_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT *, len(u) AS n, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS BIGINT) AS a, CAST(CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS BIGINT) AS b,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                   WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS pre, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS mid, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suf FROM k)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_phrases": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
        t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
        c AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, unnest([w[a : a + k - 1] FOR a IN range(1, len(w) - k + 2)]) AS g FROM w, range(1, 5) x(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
        m AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, unnest([g[: k - 1], g[2 :]]) AS g, f FROM c WHERE k > 2) GROUP BY ALL),
        s AS (SELECT lang, k, g, f, unnest(range(1, k)) AS cut FROM (SELECT c.* FROM c LEFT JOIN m ON c.lang = m.lang AND c.g = m.g WHERE k > 1 AND 100 * coalesce(m.f, 0) < 80 * c.f)),
        v AS (SELECT s.lang, s.g, s.f AS a, x.f AS l, y.f AS r, CAST(2000000 * CAST(s.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score, cut
              FROM s JOIN c x ON x.lang = s.lang AND x.g = s.g[: cut] JOIN c y ON y.lang = s.lang AND y.g = s.g[cut + 1 :]),
        b AS (SELECT *, array_to_string(g, ' ') AS phrase FROM v QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b JOIN t USING (lang)
        WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
    """,
}
