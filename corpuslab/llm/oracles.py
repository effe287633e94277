"""DuckDB SQL for the contract queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (o.key IS NOT NULL AND o.owner <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op8_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT >> 2 AS h
  FROM documents
), sums AS (
  SELECT src, source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS w
  FROM sized GROUP BY src, source
), filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM sums WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fixed AS (
  SELECT *, first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS)
            OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS final
  FROM filled
), goals AS (
  SELECT src, source_size, CASE WHEN final IS NULL THEN cap::DOUBLE ELSE final * w END AS target FROM fixed
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS base FROM goals
), bins AS (
  SELECT src, h, sum(size)::BIGINT AS words,
         coalesce(sum(sum(size)) OVER (PARTITION BY src ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below
  FROM sized GROUP BY src, h
), edges AS (
  SELECT b.src, max(b.h) AS h, max_by(b.words, b.h) AS words, max_by(target - base * source_size - b.below, b.h) AS rest
  FROM bins b JOIN budgets g ON b.src = g.src WHERE b.below <= g.target - g.base * g.source_size GROUP BY b.src
), limits AS (
  SELECT src, h + CASE WHEN words - rest <= rest THEN 1 ELSE 0 END AS bound FROM edges
)
SELECT s.doc_id, s.size, g.source_size, g.target,
       ((g.base + CASE WHEN s.h < l.bound AND g.base < 3 THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sized s JOIN budgets g ON s.src = g.src JOIN limits l ON s.src = l.src
"""

ORACLES["op9_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT doc_id, w, md5(array_to_string(words[w : w + 19], ' ')) AS h
  FROM split, unnest(generate_series(1, len(words) - 19)) AS g(w)
), judged AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY h ORDER BY doc_id, w) > 1 AS later FROM windows
), gone AS (
  SELECT DISTINCT doc_id, w + k AS p FROM judged, generate_series(0, 19) AS s(k) WHERE later
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM split
), kept AS (
  SELECT w.doc_id, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS text
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

ORACLES["op6_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, md5(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
           ELSE list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i : i + 3], ' ')) END) AS g FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a
)
SELECT r.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id
"""

ORACLES["op3_embedding_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) >= 0.95::DOUBLE * sqrt(a.n) * sqrt(b.n)
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT r.vec_id, coalesce(max(c.n), 0)::BIGINT AS n_links, min(r.other) AS component_id, min(r.other) = r.vec_id AS kept
FROM reach r LEFT JOIN counts c ON r.vec_id = c.vec_id GROUP BY r.vec_id
"""


def _ints(scale: int) -> str:
    """Whole vectors as integers; ``d`` is the length that most have."""
    return f"""usual AS (
  SELECT len(embedding) AS d FROM embeddings WHERE len(embedding) > 0 GROUP BY d ORDER BY count(*) DESC, d DESC LIMIT 1
), ints AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings, usual
  WHERE vec_id IS NOT NULL AND len(embedding) = d AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = d
)"""


_DOT = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT"

ORACLES["op11_hard_negatives"] = f"""
WITH {_ints(256)}, rows AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ints WHERE label IS NOT NULL
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, {_DOT} AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""

ORACLES["op12_top_k"] = f"""
WITH {_ints(1024)}
SELECT a.vec_id AS query_id, row_number() OVER w::INTEGER AS rank, b.vec_id, {_DOT} AS score
FROM ints a JOIN ints b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
WINDOW w AS (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id)
QUALIFY row_number() OVER w <= 10
"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    gap = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT"
    steps = [
        f"""ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), start AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec_id) - 1 AS cluster, v FROM ints
), c0 AS (SELECT cluster, v FROM start WHERE cluster < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT x.vec_id, x.v, min(struct_pack(distance := {gap}, cluster := c.cluster)) AS m FROM ints x, c{r} c GROUP BY ALL)")
        steps.append(f"s{r} AS (SELECT m.cluster AS cluster, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY ALL)")
        floor = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
        steps.append(f"m{r} AS (SELECT cluster, list({floor} ORDER BY i) AS v FROM s{r} GROUP BY cluster)")
        steps.append(f"c{r + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.m.cluster::INTEGER AS cluster, a.m.distance AS distance, sum(a.m.distance) OVER (PARTITION BY a.m.cluster)::BIGINT AS cluster_inertia,
       sum(a.m.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.m.cluster = c.cluster"""


ORACLES["op13_centroid_clusters"] = _clusters()

# Texts as hexadecimal digits, two a byte, so that windows of bytes are substrings.
ORACLES["op4_suffix_dedup"] = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), blocks AS (
  SELECT doc_id, n, b, substr(digits, (2000 * b + 1)::BIGINT, 2400) AS part FROM d, unnest(range(0, (n + 999) // 1000)) AS t(b)
), windows AS (
  SELECT doc_id, 1000 * b + j AS i, md5(substr(part, (2 * j + 1)::BIGINT, 400)) AS h FROM blocks, unnest(range(0, least(1000, n - 199 - 1000 * b))) AS t(j)
), starts AS (
  SELECT doc_id, i FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)
), marked AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER w + 200, true) AS opens FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi
  FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked) GROUP BY doc_id, span
), edges AS (
  SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS a, lo AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL
  SELECT d.doc_id, coalesce(max(hi), 0) AS a, any_value(n) AS b FROM d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), kept AS (
  SELECT e.doc_id, string_agg(substr(digits, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a, b) AS digits FROM edges e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id
), removed AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.digits)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id
"""
