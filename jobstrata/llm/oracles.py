"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from jobstrata.llm.quality_rules import FAILURE, GOOD_WEIGHT, RISK, RULES

_GRID = ", ".join(f"('{rule}', {i}, {cut}::double)" for rule, cuts in RULES.items() for i, cut in enumerate(cuts))
_RULE_RISK = RISK / len(RULES)

#: `judged` over a relation `docs`; the pipeline uses it again.
QUALITY_CTES = rf"""
t AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM docs),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT row_no, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
        FROM (SELECT row_no, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT row_no, count(*) AS n FROM (SELECT DISTINCT row_no, i + unnest([0, 1, 2]) AS j FROM rep) GROUP BY row_no),
m AS (SELECT doc_id, stratum, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(cov.n, 0)::bigint AS n_repeat_words,
             length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::bigint AS n_upper,
             length(regexp_replace(text, '[^!]', '', 'g'))::bigint AS n_bang
      FROM w LEFT JOIN cov USING (row_no)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_symbols / greatest(word_chars, 1) AS symbol_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
             n_dup_lines::double AS dup_lines, n_upper / greatest(word_chars, 1) AS upper_share,
             n_bang / greatest(n_words, 1) AS bang_share FROM m),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT f.*, quality, $half AS half FROM f JOIN known USING (doc_id) WHERE NOT base_failed AND stratum IS NOT NULL),
long AS (SELECT stratum, half, quality, unnest([{", ".join(f"'{r}'" for r in RULES)}]) AS rule,
                unnest([{", ".join(RULES)}]) AS v FROM lab),
grid (rule, number, cutoff) AS (VALUES {_GRID}),
tried AS (SELECT stratum, rule, number, cutoff FROM (SELECT DISTINCT stratum FROM lab), grid),
over AS (SELECT stratum, rule, number, cutoff, count(*) FILTER (half = 1 AND quality <> 0) AS n,
                count(*) FILTER (half = 1 AND quality <> 0 AND v > cutoff) AS k,
                count(*) FILTER (half = 0 AND quality = 0 AND v > cutoff) AS bad,
                count(*) FILTER (half = 0 AND quality <> 0 AND v > cutoff) AS good
         FROM tried JOIN long USING (stratum, rule) GROUP BY ALL),
tail AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                + i * ln({_RULE_RISK}) + (n - i) * ln(1 - {_RULE_RISK})))) AS chance FROM over WHERE k < n * {_RULE_RISK}),
best AS (SELECT stratum, rule, cutoff FROM tail WHERE chance <= {FAILURE} / (SELECT count(*) FROM tried)
                AND bad - {GOOD_WEIGHT} * good > 0
         QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - {GOOD_WEIGHT} * good DESC, cutoff DESC) = 1),
judged AS (SELECT f.*, NOT base_failed {" ".join(f"AND NOT coalesce({r} > (SELECT cutoff FROM best b WHERE b.stratum = f.stratum AND b.rule = '{r}'), false)" for r in RULES)} AS kept FROM f)
"""


def _crc32(value):
    """CRC-32 of a short ASCII text in DuckDB SQL, bit by bit."""
    return (f"list_reduce(list_concat([4294967295::bigint], list_transform(string_split({value}, ''), lambda x: ascii(x)::bigint)), "
            "lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), "
            "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))")


QUALITY_CTES = QUALITY_CTES.replace("$half", f"xor({_crc32('doc_id::varchar')}, 4294967295) % 2")

ORACLES = {
    "op4_quality_rules": f"""WITH docs AS (SELECT * FROM documents), {QUALITY_CTES}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged""",
    "op8_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op2_suffix_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        win AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS g
                FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w)),
        m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win),
        p AS (SELECT DISTINCT 'repeat' AS kind, doc_id, i + unnest(range(50)) AS p FROM m WHERE n > 1
              UNION ALL SELECT DISTINCT 'cut', doc_id, i + unnest(range(50)) FROM m WHERE r > 1),
        runs AS (SELECT *, p - row_number() OVER (PARTITION BY kind, doc_id ORDER BY p) AS run FROM p)
        SELECT doc_id, kind, min(p)::bigint AS start_word, (max(p) + 1)::bigint AS end_word, (max(p) + 1 - min(p))::bigint AS n_words
        FROM runs GROUP BY kind, doc_id, run""",
    "op3_minhash_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id,
               doc_id = least(doc_id, coalesce(low.b, doc_id)) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)""",
    "op13_vector_codes": r"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, v FROM v),
        p AS MATERIALIZED (SELECT r, vec_id, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM x, range(16) AS t(part)),
        b0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1) AS entry, x AS e FROM p
          QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 64),
        d0 AS MATERIALIZED (SELECT r, part, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))::bigint AS d
          FROM p JOIN b0 USING (part)),
        a0 AS MATERIALIZED (SELECT r, part, entry, d FROM d0 QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1),
        m0 AS MATERIALIZED (SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*))::bigint AS m
          FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM p JOIN a0 USING (r, part)) GROUP BY part, entry, i) GROUP BY part, entry),
        b1 AS MATERIALIZED (SELECT part, entry, coalesce(m, e) AS e FROM b0 LEFT JOIN m0 USING (part, entry)),
        d1 AS MATERIALIZED (SELECT r, part, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))::bigint AS d
          FROM p JOIN b1 USING (part)),
        a1 AS MATERIALIZED (SELECT r, part, entry, d FROM d1 QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1),
        m1 AS MATERIALIZED (SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*))::bigint AS m
          FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM p JOIN a1 USING (r, part)) GROUP BY part, entry, i) GROUP BY part, entry),
        b2 AS MATERIALIZED (SELECT part, entry, coalesce(m, e) AS e FROM b1 LEFT JOIN m1 USING (part, entry)),
        d2 AS MATERIALIZED (SELECT r, part, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))::bigint AS d
          FROM p JOIN b2 USING (part)),
        a2 AS MATERIALIZED (SELECT r, part, entry, d FROM d2 QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1),
        h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM b2),
        c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM a2 GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, h AS codebooks_sha256
        FROM x JOIN c USING (r), h""",
}
