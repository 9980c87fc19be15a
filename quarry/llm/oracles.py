"""SQL of the queries that SQL can express."""

#: Every position's 50 bytes, the smallest doc_id of each string, merged runs, what is left.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
  pos AS (SELECT doc_id, i, t[i:i + 49] AS s FROM (SELECT doc_id, t, unnest(generate_series(1, octet_length(t) - 49)) AS i FROM d WHERE octet_length(t) >= 50)),
  least AS (SELECT s, min(doc_id) AS m FROM pos GROUP BY s),
  gone AS (SELECT doc_id, i FROM pos JOIN least USING (s) WHERE m < doc_id),
  marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS first FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  numbered AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
  runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS b FROM numbered GROUP BY doc_id, run),
  before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM runs),
  left_ AS (SELECT doc_id, sum(b - a + 1)::bigint AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(CASE WHEN a > e + 1 THEN hex(t[e + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS kept FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(t)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
  sha256(CASE WHEN last IS NULL THEN t WHEN last < octet_length(t) THEN from_hex(kept || hex(t[last + 1:octet_length(t)])) ELSE from_hex(kept) END) AS kept_sha256
FROM d LEFT JOIN left_ USING (doc_id)
"""

#: Shares, all exponents in steps of a millionth, the mix's exponent, each source's blocks, the rows within the budget.
MIXING = """
WITH unit AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, count(*) AS n_rows, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+')))::bigint AS n_tokens FROM documents GROUP BY ALL),
  sources AS (SELECT source, sum(n_tokens)::double AS tokens FROM unit GROUP BY source HAVING sum(n_tokens) > 0),
  total AS (SELECT sum(tokens) AS t, count(*) AS n FROM sources),
  shares AS (SELECT source, tokens, tokens / t AS share FROM sources, total),
  grid AS (SELECT k, ln(sum(w)) - k / 1e6 * sum(w * ln(share)) / sum(w) AS entropy, any_value(t) * max(w / tokens) / sum(w) AS repeats
    FROM (SELECT k, share, tokens, t, exp(k / 1e6 * ln(share)) AS w FROM shares, total, range(1000001) r(k)) GROUP BY k),
  alpha AS (SELECT greatest((SELECT max(k) FROM grid, total WHERE entropy >= 0.985 * ln(n) - 1e-12), (SELECT coalesce(min(k), 0) FROM grid WHERE repeats <= 4 + 1e-9)) / 1e6 AS a),
  goal AS (SELECT source, tokens AS total, floor(exp(a * ln(share)) / (SELECT sum(exp(a * ln(share))) FROM shares) * t + 1e-6)::bigint AS goal FROM shares, alpha, total),
  plan AS (SELECT source, total, goal // total::bigint AS blocks, goal % total::bigint AS rest, goal FROM goal),
  rows_ AS (SELECT u.*, p.*, b, md5('mix:' || b || ':' || coalesce(doc_id::varchar, '') || ':' || digest) AS h FROM unit u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(p.blocks + 1)) AS b)),
  placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, b ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM rows_)
SELECT doc_id, source, n_tokens, b AS block, round((b * total + upto - n_tokens) / goal, 9) AS at FROM placed WHERE b < blocks OR upto <= rest
"""

#: Failures of each document, the 120 orders by joining letters, and each step's counts from all documents.
FILTER_AUDIT = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, length(t) AS points FROM d),
  f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * points AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int AS mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
  x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
  steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
    coalesce(list_sum([1 << (ascii(z) - 65) FOR z IN string_split(filter_order[1:step - 1], '') IF z <> '']), 0)::int AS before FROM orders, range(1, 6) r(step)),
  counts AS (SELECT part, filter_order, step::int AS step, own,
    sum(n) FILTER (mask & own = 0 AND mask & before = 0) AS kept, sum(n) FILTER (mask & own <> 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & own <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
    sum(good) FILTER (mask & own <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0) AS toxic_lost
    FROM m, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant,
  coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::bigint AS shapley FROM counts
"""

#: Nodes of all levels by recursion, of the sources' trees and then of the tree over them; each leaf's way up, changed and not.
MANIFEST = """
WITH RECURSIVE d AS (SELECT doc_id, source, [doc_id::varchar, source, lang, n_chars::varchar, text] AS was,
    [doc_id::varchar, source, lang, n_chars::varchar, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')] AS now,
    doc_id IS NOT NULL AND xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, [ascii(x)::ubigint FOR x IN string_split(doc_id::varchar, '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1))))) % 5 = 0 AS hit FROM documents),
  l AS (SELECT doc_id, source, coalesce(hit, false) AS hit, sha256(list_aggregate([coalesce(octet_length(encode(x)) || ':' || x, '-') FOR x IN was], 'string_agg', '')) AS leaf,
    sha256(list_aggregate([coalesce(octet_length(encode(x)) || ':' || x, '-') FOR x IN now], 'string_agg', '')) AS changed FROM d),
  p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM l),
  nodes AS (SELECT 0 AS level, source, place, n, leaf AS node, NULL::varchar AS preimage FROM p
    UNION ALL SELECT level + 1, source, place, n, sha256(pre), pre FROM (SELECT level, source, place // 16 AS place, (n + 15) // 16 AS n, string_agg(node, '' ORDER BY place) AS pre
      FROM nodes WHERE n > 1 GROUP BY level, source, nodes.place // 16, (nodes.n + 15) // 16)),
  tops AS (SELECT level AS height, source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
  crown AS (SELECT 0 AS level, place, n, node, NULL::varchar AS preimage FROM tops
    UNION ALL SELECT level + 1, place, n, sha256(pre), pre FROM (SELECT level, place // 16 AS place, (n + 15) // 16 AS n, string_agg(node, '' ORDER BY place) AS pre
      FROM crown WHERE n > 1 GROUP BY level, crown.place // 16, (crown.n + 15) // 16)),
  ways AS (SELECT p.doc_id, p.leaf, p.place AS own, t.node AS subroot, p.source, t.place AS top, t.height, 0 AS level, CASE WHEN hit THEN changed ELSE p.leaf END AS h, ''::varchar AS proof,
      t.height + (SELECT max(level) FROM crown) AS last FROM p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source
    UNION ALL SELECT doc_id, leaf, own, subroot, source, top, height, level + 1, sha256(a || h || z), proof || a || z, last
      FROM (SELECT w.*, coalesce(x.preimage, c.preimage)[1:64 * slot] AS a, coalesce(x.preimage, c.preimage)[64 * slot + 65:] AS z
        FROM (SELECT *, CASE WHEN level < height THEN own // (16 ** least(level, height))::bigint ELSE top // (16 ** greatest(level - height, 0))::bigint END % 16 AS slot FROM ways WHERE level < last) w
        LEFT JOIN nodes x ON w.level < w.height AND x.level = w.level + 1 AND x.source IS NOT DISTINCT FROM w.source AND x.place = w.own // (16 ** least(w.level + 1, w.height))::bigint
        LEFT JOIN crown c ON w.level >= w.height AND c.level = w.level - w.height + 1 AND c.place = w.top // (16 ** greatest(w.level - w.height + 1, 0))::bigint))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM ways, (SELECT node AS root FROM crown WHERE n = 1) WHERE level = last
"""

#: All pairs of a query and another vector of its length.
TOP_K = """
WITH v AS (SELECT vec_id, [floor(1024 * x::double)::bigint::double FOR x IN embedding] AS c, row_number() OVER () AS r FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.c, c.c)::bigint AS score FROM v q JOIN v c ON len(q.c) = len(c.c) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10
"""
