"""DuckDB SQL of the queries of this subpackage that SQL can express."""

SQL = {
    "op6_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ), windows AS (
            SELECT doc_id, i, list_slice(words, i, i + 49) AS body FROM split, unnest(range(1, len(words) - 48)) AS t(i)
        ), later AS (
            SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY body) AS first FROM windows) WHERE first < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, j FROM later, unnest(range(i, i + 50)) AS u(j)
        ), placed AS (
            SELECT s.doc_id, p.j, s.words[p.j] AS word, g.j IS NULL AS stays
            FROM split s, unnest(range(1, len(s.words) + 1)) AS p(j) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.j = p.j
        ), kept AS (
            SELECT doc_id, count(*) FILTER (WHERE NOT stays) AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE stays), '') AS body FROM placed GROUP BY doc_id
        )
        SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
               sha256(coalesce(k.body, '')) AS kept_sha256
        FROM split s LEFT JOIN kept k USING (doc_id)
    """,
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)
    """,
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages), g AS (
            SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM g
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
               n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM positives JOIN scored n USING (anchor_id)
        WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 5
    """,
}
