"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations


def centroids(dims: int, k: int, rounds: int, seed: int, scale: int) -> str:
    """k-means over whole numbers: one pair of subqueries a round, written out."""
    far = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    nearest = "SELECT p.r, arg_min(c.c, ({far}, c.c)) AS c, min({far}) AS d FROM kept p CROSS JOIN c{n} c GROUP BY p.r"
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(far=far, n=n)})")
        steps.append(
            f"""c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
            SELECT c, list(s ORDER BY i) AS v FROM (SELECT a.c, i, CAST((sum(p.v[i]) - ((sum(p.v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS s
              FROM a{n} a JOIN kept p USING (r), range(1, {dims + 1}) t(i) GROUP BY a.c, i) GROUP BY c) m ON m.c = o.c)"""
        )
    return f"""WITH {", ".join(steps)}, z AS MATERIALIZED ({nearest.format(far=far, n=rounds)})
    SELECT p.vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(z.d AS BIGINT) AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM z JOIN kept p USING (r) JOIN c{rounds} c ON c.c = z.c"""


def spellings(every: int, shortest: int, least: int, times: int) -> str:
    """Words, near words by equal deletions, and forms followed by recursion; crc32 is written
    out over bytes, as DuckDB has none."""
    bytes_of = "flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
    step = "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce(list_concat([t], range(8)), {step}) ORDER BY t) AS crcs FROM range(256) r(t)),
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
    hashed AS (SELECT run, n, xor(list_reduce({bytes_of}, lambda h, b: xor(h >> 8, crcs[xor(h & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM runs, crc),
    words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % {every} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed) WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {least}),
    cuts AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word)),
    best AS (SELECT word, count(*) AS n_near, arg_min({{'w': other, 'm': m}}, (-m, other)) AS top FROM near GROUP BY word),
    judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.m >= {times} * w.n THEN top.w END AS form, CASE WHEN top.m >= {times} * w.n THEN top.m END AS form_n FROM words w LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS spot FROM judged UNION ALL SELECT walk.word, j.form FROM walk JOIN judged j ON j.word = walk.spot WHERE j.form IS NOT NULL)
    SELECT j.word, j.form, r.spot AS root, j.n, CAST(j.n_near AS BIGINT) AS n_near, j.form_n
    FROM judged j JOIN (SELECT walk.word, walk.spot FROM walk JOIN judged e ON e.word = walk.spot WHERE e.form IS NULL) r ON r.word = j.word"""
