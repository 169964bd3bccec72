"""DuckDB counterparts of the training-data queries that SQL can express."""

from __future__ import annotations

#: The mix, with the parameters of its query: seed 7, blocks of 16 words, 3 copies at most.
MIX = r"""
WITH d AS (
    SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS key
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, ceil(sqrt(count(*)::DOUBLE) / 2)::BIGINT AS shards,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM d GROUP BY source
), levels AS (
    SELECT *, 3 * source_size AS cap,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
    FROM s
    WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
    SELECT source, source_size, shards, CASE WHEN cap <= weight * level THEN cap::DOUBLE
        ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target
    FROM levels
), shard AS (
    SELECT d.source, d.key % s.shards AS shard, sum(d.size)::BIGINT AS shard_size,
        ceil(sum(d.size) / 16.0)::BIGINT AS blocks
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL
), limits AS (
    SELECT source, 3 * sum(blocks)::BIGINT AS most FROM shard GROUP BY source
), source_votes AS (
    SELECT a.source, a.target AS votes, l.most, floor((sum(a.target) OVER () + 8) / 16)::BIGINT AS total
    FROM aimed a JOIN limits l ON a.source IS NOT DISTINCT FROM l.source
), source_exact AS (
    SELECT *, CASE WHEN sum(votes) OVER () > 0 THEN votes * total / sum(votes) OVER () ELSE 0 END AS exact,
        count(*) OVER () AS parties
    FROM source_votes
), source_sure AS (
    SELECT *, CASE WHEN total > 0 THEN ceil(parties * exact / (2 * total))::BIGINT + 1 ELSE 1 END AS spare,
        least(greatest(floor(exact)::BIGINT - CASE WHEN total > 0
            THEN ceil(parties * exact / (2 * total))::BIGINT + 1 ELSE 1 END, 0), most) AS sure
    FROM source_exact
), source_quotients AS (
    SELECT source, votes / (2 * k + 1) AS q, total - (SELECT sum(sure) FROM source_sure) AS open
    FROM source_sure, unnest(generate_series(sure, least(floor(exact)::BIGINT + spare, most) - 1)) AS u(k)
    WHERE votes > 0
), source_won AS (
    SELECT source, count(*) AS won FROM (
        SELECT source, open, row_number() OVER (ORDER BY q DESC, source NULLS LAST) AS r FROM source_quotients
    ) WHERE r <= open GROUP BY source
), source_seats AS (
    SELECT s.source, s.sure + coalesce(w.won, 0) AS total
    FROM source_sure s LEFT JOIN source_won w ON s.source IS NOT DISTINCT FROM w.source
), shard_votes AS (
    SELECT h.source, h.shard, h.shard_size::DOUBLE AS votes, h.blocks, 3 * h.blocks AS most, t.total
    FROM shard h JOIN source_seats t ON h.source IS NOT DISTINCT FROM t.source
), shard_exact AS (
    SELECT *, CASE WHEN sum(votes) OVER g > 0 THEN votes * total / sum(votes) OVER g ELSE 0 END AS exact,
        count(*) OVER g AS parties
    FROM shard_votes WINDOW g AS (PARTITION BY source)
), shard_sure AS (
    SELECT *, CASE WHEN total > 0 THEN ceil(parties * exact / (2 * total))::BIGINT + 1 ELSE 1 END AS spare,
        least(greatest(floor(exact)::BIGINT - CASE WHEN total > 0
            THEN ceil(parties * exact / (2 * total))::BIGINT + 1 ELSE 1 END, 0), most) AS sure
    FROM shard_exact
), shard_open AS (
    SELECT *, total - sum(sure) OVER (PARTITION BY source) AS open FROM shard_sure
), shard_won AS (
    SELECT source, shard, count(*) AS won FROM (
        SELECT source, shard, open,
            row_number() OVER (PARTITION BY source ORDER BY votes / (2 * k + 1) DESC, shard) AS r
        FROM shard_open, unnest(generate_series(sure, least(floor(exact)::BIGINT + spare, most) - 1)) AS u(k)
        WHERE votes > 0
    ) WHERE r <= open GROUP BY source, shard
), quota AS (
    SELECT o.source, o.shard, greatest(o.blocks, 1) AS blocks, o.sure + coalesce(w.won, 0) AS seats
    FROM shard_open o LEFT JOIN shard_won w ON o.source IS NOT DISTINCT FROM w.source AND o.shard = w.shard
), placed AS (
    SELECT d.doc_id, d.size, a.source_size, a.target, q.blocks, q.seats,
        sum(d.size) OVER (PARTITION BY d.source, q.shard ORDER BY d.key, d.doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
    FROM d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
    JOIN quota q ON d.source IS NOT DISTINCT FROM q.source AND d.key % a.shards = q.shard
)
SELECT doc_id, size, source_size, target,
    (seats // blocks * size + greatest(least(seats % blocks * 16 - start, size), 0))::BIGINT AS taken
FROM placed
"""

#: What the archives hold of every page.
WARC = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), h AS (
    SELECT *, CASE WHEN payload_bytes >= 1000
        THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS holder
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM h
"""

#: Repeated lines dropped: keys of 40 code points in 5 documents, kept in the largest id.
LINE_DEDUP = r"""
WITH lines AS (
    SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.*, coalesce(k.doc_id < r.last, false) AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Five filters in all 120 orders.
FILTER_AUDIT = r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
        CASE WHEN len(w) < 200 THEN 'A' END,
        CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
        CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 'E' END
    ], lambda x: x IS NOT NULL) AS fails
    FROM words LEFT JOIN marks USING (doc_id)
), counted AS (
    SELECT part, good, toxic, fails, count(*) AS n FROM docs GROUP BY ALL
), letters(l) AS (
    VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
    SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own,
        string_split(filter_order[1:step - 1], '') AS before
    FROM orders, generate_series(1, 5) AS s(step)
), audit AS (
    SELECT part, filter_order, step, own,
        sum(CASE WHEN NOT list_has_any(fails, before) AND NOT list_contains(fails, own) THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, own) THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN list_has_any(fails, before) AND list_contains(fails, own) THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = [own] THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN good AND NOT list_has_any(fails, before) AND list_contains(fails, own) THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN toxic AND NOT list_has_any(fails, before) AND list_contains(fails, own) THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM counted, steps GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM audit
"""


def clusters(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Centroids in exact integers: a step of the query for each round."""
    parts = [
        f"""kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
)""",
        f"""c0 AS (
    SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1)::INTEGER AS c, v
    FROM kept QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) <= {k}
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
    SELECT kept.vec_id, any_value(kept.v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT kept.vec_id, c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM kept, c{r}
    ) AS far JOIN kept USING (vec_id) GROUP BY kept.vec_id
)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
    SELECT c, list(m ORDER BY i) AS v FROM (
        SELECT c, i, CASE WHEN s % n < 0 THEN (s - (s % n + n)) // n ELSE (s - s % n) // n END AS m FROM (
            SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, generate_series(1, {dims}) AS g(i) GROUP BY c, i
        )
    ) GROUP BY c
)""")
            parts.append(f"""c{r + 1} AS (
    SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c)
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a{rounds}.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""
