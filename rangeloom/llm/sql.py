"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT src AS node, src AS seen FROM links
  UNION
  SELECT r.node, l.dst FROM reach r JOIN links l ON r.seen = l.src),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
degree AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id) AS component_id, coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.src LEFT JOIN comp c ON e.vec_id = c.node
"""

OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS shuffle
  FROM documents),
srcs AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank
  FROM docs GROUP BY source),
stops AS (
  SELECT *, 3 * source_size AS stop, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         sum(source_size) OVER ()::BIGINT AS budget
  FROM srcs),
levels AS (
  SELECT *, (budget - coalesce(sum(stop) OVER before, 0))::DOUBLE / sum(weight) OVER upward AS level
  FROM stops
  WINDOW before AS (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upward AS (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
water AS (
  SELECT coalesce(arg_min(level, (stop / weight, rank)) FILTER (WHERE weight * level < stop), 0) AS level FROM levels),
targets AS (
  SELECT s.source, s.source_size, s.rank, s.budget, least(s.weight * w.level, s.stop::DOUBLE) AS target FROM stops s, water w),
queued AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.rank, t.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.size, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT q.*, e.epoch, CASE WHEN target > 0 THEN (source_size * e.epoch + so_far)::DOUBLE / target ELSE 0 END AS finish
  FROM queued q, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM turns),
taken AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM merged WHERE spent <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""


def op8_sql(rules: Sequence[tuple[str, str]], levels: int = 8, support: int = 20, z: float = 2.0, weight: float = 10.0, bands: int = 64, limit: float = 0.5) -> str:
    """The template tree for paths of at most ``levels`` segments, which SQL has to spell out one by one."""
    w = f"{weight}::DOUBLE"
    rule = lambda k: " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{(r, v)[k]}'" for v, r in sorted(rules, key=lambda x: -len(x[1]))
    )
    steps = []
    for k in range(levels):
        steps.append(f"""
done{k} AS (SELECT host, path, labelled, bad, template || repeat('/*', greatest(len(parts) - {k}, 0)) AS template FROM live{k} WHERE len(parts) <= {k} OR NOT open),
inner{k} AS (SELECT *, CASE WHEN regexp_matches(parts[{k + 1}], '[0-9]') THEN '*' ELSE parts[{k + 1}] END AS segment FROM live{k} WHERE len(parts) > {k} AND open),
child{k} AS (
  SELECT *, CASE WHEN n < {support} OR labelled = 0 THEN '*' ELSE segment END AS plain, sum(labelled) OVER p AS all_labelled, sum(bad) OVER p AS all_bad
  FROM (SELECT host, template, segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM inner{k} GROUP BY ALL) WINDOW p AS (PARTITION BY host, template)),
member{k} AS (
  SELECT *, least(floor((bad + {w} * ((all_bad + 1)::DOUBLE / (all_labelled + 2))) / (labelled + {w}) * {bands}), {bands - 1})::INT AS band
  FROM (SELECT host, template, plain, all_labelled, all_bad, sum(labelled) AS labelled, sum(bad) AS bad FROM child{k} GROUP BY ALL) WHERE labelled > 0),
band{k} AS (
  SELECT host, template, band, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad, count(*) AS members, min(plain) AS first, max((plain = '*')::INT) AS wild FROM member{k} GROUP BY ALL),
lag{k} AS (
  SELECT *, lag(labelled) OVER w AS l, lag(bad) OVER w AS b, (bad + lag(bad) OVER w + 1) / (labelled + lag(labelled) OVER w + 2) AS pooled FROM band{k} WINDOW w AS (PARTITION BY host, template ORDER BY band)),
group{k} AS (
  SELECT *, sum(coalesce(abs(bad / labelled - b / l) > {z}::DOUBLE * sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / l)), false)::INT) OVER (PARTITION BY host, template ORDER BY band) AS g FROM lag{k}),
name{k} AS (
  SELECT host, template, band, CASE WHEN max(wild) OVER q = 1 OR max(g) OVER p = 0 THEN '*' WHEN sum(members) OVER q = 1 THEN min(first) OVER q ELSE '*' || g::VARCHAR END AS name
  FROM group{k} WINDOW p AS (PARTITION BY host, template), q AS (PARTITION BY host, template, g)),
placed{k} AS (
  SELECT i.host, i.path, i.n, i.labelled, i.bad, i.parts, i.template || '/' || coalesce(b.name, '*') AS template
  FROM inner{k} i JOIN child{k} c ON c.host = i.host AND c.template = i.template AND c.segment = i.segment
  LEFT JOIN member{k} m ON m.host = i.host AND m.template = i.template AND m.plain = c.plain
  LEFT JOIN name{k} b ON b.host = i.host AND b.template = i.template AND b.band = m.band),
live{k + 1} AS (SELECT *, sum(n) OVER t >= {support} AND sum(bad) OVER t > 0 AND sum(bad) OVER t < sum(labelled) OVER t AS open FROM placed{k} WINDOW t AS (PARTITION BY host, template))""")
    done = " UNION ALL ".join(f"SELECT * FROM done{k}" for k in range(levels))
    return f"""
WITH rows AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
paths AS (SELECT host, path, count(*) AS n, try_cast(regexp_extract(path, '(?s).*/([0-9]{{1,18}})(?:\\.[A-Za-z]+)?(?:/|$)', 1) AS BIGINT) AS key FROM rows GROUP BY ALL),
known AS (
  SELECT doc_id AS key, max(greatest(CASE WHEN quality = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
  HAVING bad IS NOT NULL),
live0 AS (
  SELECT host, path, n, CASE WHEN known.bad IS NULL THEN 0 ELSE n END AS labelled, coalesce(known.bad, 0) * n AS bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, '' AS template, true AS open
  FROM paths LEFT JOIN known USING (key)),{",".join(steps)},
templates AS ({done}),
purity AS (
  SELECT *, sum(bad) OVER (PARTITION BY host) AS host_bad, sum(labelled) OVER (PARTITION BY host) AS host_labelled, CASE WHEN sum(labelled) OVER () = 0 THEN 0 ELSE (sum(bad) OVER () + 1)::DOUBLE / (sum(labelled) OVER () + 2) END AS prior
  FROM (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM templates GROUP BY ALL)),
judged AS (
  SELECT host, template, (bad + {w} * ((host_bad + {w} * prior) / (host_labelled + {w}))) / (labelled + {w}) AS purity FROM purity)
SELECT page_id, host, path, CASE {rule(0)} END AS rule,
       coalesce(CASE {rule(1)} END, CASE WHEN purity >= {limit} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity
FROM rows LEFT JOIN templates USING (host, path) LEFT JOIN judged USING (host, template)
"""


OP13_SQL = r"""
WITH keyed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, ('0x' || k[1:8])::BIGINT AS h1, ('0x' || k[9:16])::BIGINT AS h2, ('0x' || k[17:24])::BIGINT AS h3,
         ('0x' || k[25:32])::BIGINT AS h4
  FROM keyed),
cut AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS one, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(tokens[1:one], ''), '') AS prefix, coalesce(array_to_string(tokens[one + 1:two], ''), '') AS middle, coalesce(array_to_string(tokens[two + 1:n], ''), '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
