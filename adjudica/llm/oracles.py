"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

_OP2 = r"""
WITH u AS (
  SELECT page_id, url,
         CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path
  FROM u),
r AS (
  SELECT *,
    CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(rest, '(?i)^[^/?#]*\b(porn|xxx|casino)\b')
         OR regexp_matches(rest, '(?i)^[^?#]*/(cart|checkout|login|signup|wp-admin)(/|$|[?#])')
         OR regexp_matches(rest, '(?i)[?&](phpsessid|replytocom)=')
         OR regexp_matches(rest, '(?i)^[^?#]*\.rss($|[?#])') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""

_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT rid, i, list_slice(words, i, i + 7) AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM t) GROUP BY rid),
b AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
k AS (
  SELECT *, base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3
         OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15 AS failure FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failure) AS x FROM k GROUP BY source),
q AS (SELECT avg(x / n) AS m, var_pop(x / n) AS v, avg(1 / n) AS k FROM h),
r AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * k, 1e-9) - 1, 1), 1000) AS s FROM q),
z AS (SELECT source AS host, (x + m * s) / (n + s) AS rate FROM h, r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM k JOIN z ON k.source IS NOT DISTINCT FROM z.host
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
    CASE WHEN level >= fill THEN cap ELSE weight * (SELECT arg_min(level, fill) FROM l WHERE level < fill) END AS target FROM l),
o AS (
  SELECT d.*, CASE WHEN size <= 0 THEN 0 ELSE floor(log2(size::DOUBLE) * 16)::BIGINT + 1 END AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, h, doc_id, size) AS k FROM o),
x AS (
  SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1' || coalesce(r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT * size) AS taken FROM x
"""

_OP9 = r"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (SELECT DISTINCT item, n, list_slice(w, k, k + n - 1) AS gram
      FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
v AS (SELECT rid, n, k, list_slice(w, k, k + n - 1) AS gram
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT rid, k, v.n, item FROM v JOIN g ON v.n = g.n AND v.gram = g.gram),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""

def clustering_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Operator 13 written out round by round."""
    gap = "list_sum(list_transform(range(1, 65), lambda j: (v[j] - z[j]) * (v[j] - z[j])))::bigint"
    parts = [
        """q AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 65536)) = 64)""",
        f"c0 AS MATERIALIZED (SELECT c, z FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS z FROM q) WHERE c < {k})",
    ]
    nearest = lambda i: f"SELECT rid, vec_id, v, min(d * {k} + c) AS m FROM (SELECT rid, vec_id, v, c, {gap} AS d FROM q, c{i}) GROUP BY ALL"
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v, m % {k} AS c FROM ({nearest(i)}))")
        parts.append(f"s{i} AS (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY 1, 2)")
        parts.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY j) AS z FROM s{i} GROUP BY 1)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.z, c{i}.z) AS z FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)")
    parts.append(f"f AS MATERIALIZED (SELECT vec_id, (m % {k})::int AS cluster, m // {k} AS distance FROM ({nearest(rounds)}))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::bigint AS cluster_inertia, (sum(distance) OVER ())::bigint AS inertia,
sha256(array_to_string(z, ',')) AS centroid_sha256 FROM f JOIN c{rounds} ON c = cluster"""


ORACLE_SQL = {
    "op2_url_filter": _OP2, "op5_quality": _OP5, "op6_mixing": _OP6, "op9_decontamination": _OP9, "op13_clustering": clustering_sql(),
}
