"""DuckDB statements of the registered queries of this folder (where SQL can
express them)."""

_WORD = r"[^\x20\x09-\x0D]+"
_SP = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS w FROM per),
lv AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
     - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w),
best AS (SELECT lvl FROM lv WHERE 2.0::DOUBLE * source_size::DOUBLE >= lvl * w
         ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size::DOUBLE < lvl * w
         THEN 2.0::DOUBLE * source_size::DOUBLE ELSE lvl * w END AS target FROM w, best),
r AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE
      AS u
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""

_BOILER = (r"(?i)(^|[^a-z])(cookies?|javascript|all rights reserved|privacy policy|terms of (use|service)|"
           r"sign in|log in|click here|subscribe|lorem ipsum|copyright [0-9]{4}|share this|read more)([^a-z]|$)")
_END = r"[.!?…:;,\"''”»)\]]$"

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{_WORD}') AS w FROM d),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again)
        GROUP BY rid),
ln AS (
  SELECT rid, len(x) - len(list_distinct(x)) AS n_dup
  FROM (SELECT rid, list_filter(string_split(t, chr(10)), lambda y: length(translate(y, {_SP}, '')) > 0) AS x FROM d)),
tr AS (SELECT rid, unnest(list_transform(string_split(t, chr(10)), lambda y: trim(y, {_SP}))) AS l FROM d),
lr AS (
  SELECT rid, l, length(l) AS n, length(l) - length(translate(l, '|›»•>', '')) AS nav,
    length(l) - length(translate(l, '#*$%&|<>', '')) AS sym
  FROM tr WHERE length(l) > 0),
left_over AS (
  SELECT rid, sum(length(translate(l, {_SP}, '')))::BIGINT AS c FROM lr
  WHERE NOT ((nav >= 3 AND nav * 20 >= n) OR sym * 10 >= n OR regexp_matches(l, '{_BOILER}')
    OR (NOT regexp_matches(l, '{_END}') AND len(regexp_extract_all(l, '{_WORD}')) < 6))
  GROUP BY rid),
q AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(translate(t, {_SP}, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    ln.n_dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(left_over.c, 0)::BIGINT AS kept_chars
  FROM d JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN left_over USING (rid))
SELECT *, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND kept_chars * 100 >= word_chars * 50 AS kept
FROM q
"""


def _op11(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds: every distance of every vector to every centroid."""
    gap = "list_sum(list_transform(list_zip(v.p, c{0}.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, p FROM v ORDER BY h, p LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.rid, c{i}.c, {gap.format(i)} AS d FROM v, c{i}) GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT c, list(q ORDER BY j) AS p
  FROM (SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q
        FROM (SELECT c, j, sum(x) AS s, count(*) AS n
              FROM (SELECT a{i}.c, unnest(v.p) AS x, unnest(range(64)) AS j FROM v JOIN a{i} USING (rid))
              GROUP BY c, j))
  GROUP BY c),
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m{i}.p, c{i}.p) AS p FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(e.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} e ON e.c = a.c"""


SQL = {"op4_mix_sources": OP4, "op10_line_quality": OP10, "op11_centroids": _op11()}
