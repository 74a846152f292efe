"""SQL of the training-data queries whose results are determined by their definition, for DuckDB."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str, lower: bool) -> str:
    text = f"translate({text}, '{_UPPER}', '{_LOWER}')" if lower else text
    return f"CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all({text}, '{pattern}') END"


OP2 = f"""WITH d AS (SELECT doc_id, {_words('text', _ALNUM, True)} AS w FROM documents),
  b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_words('text', _ALNUM, True)} AS w FROM benchmark) WHERE len(w) > 0),
  bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
  dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
  h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
  c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _SPACED, True)} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
  r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a)
  SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.node) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id"""

OP4 = f"""WITH d AS (SELECT doc_id, {_words('text', _SPACED, False)} AS w FROM documents),
  x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
  f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM x),
  g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE rn > 1),
  v AS (SELECT doc_id, w[p] AS word, p FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d)),
  k AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.p) AS kept FROM v LEFT JOIN g ON v.doc_id = g.doc_id AND v.p = g.p WHERE g.p IS NULL GROUP BY v.doc_id),
  c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
  FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
  r AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.node = l.a),
  c AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
  SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON a = c.vec_id"""

OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
  t AS (SELECT *, strlen(h) >= 1000 AND page_id <> last AS again FROM p)
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM t"""

OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0)
  SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

#: The checksum's polynomial and masks are fixed values.
OP12 = """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
  r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
  b AS (SELECT run, k, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS bytes FROM r),
  h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, t),
  m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
  v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
  d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
  p AS (SELECT x.word AS a, y.word AS b, y.n FROM d x JOIN d y ON x.i = y.i AND x.less = y.less AND x.word <> y.word
    UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
  c AS (SELECT a, count(*) AS n_near, max(n) AS best_n FROM p GROUP BY a),
  o AS (SELECT p.a, min(p.b) AS best FROM p JOIN c ON p.a = c.a AND p.n = c.best_n GROUP BY p.a),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n
    FROM v LEFT JOIN c ON v.word = c.a LEFT JOIN o ON v.word = o.a),
  l AS (SELECT word, form, word AS root, form AS further FROM f UNION ALL SELECT l.word, l.form, f.word, f.form FROM l JOIN f ON l.further = f.word)
  SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN l ON f.word = l.word WHERE l.further IS NULL""".replace("{upper}", _UPPER).replace("{lower}", _LOWER)

OP13 = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
  b AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
      || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
      || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN b ON doc_id = id),
  g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, failed),
  x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
  a AS (SELECT filter_order, step, filter_order[step] AS f, failed, contains(failed, filter_order[step]) AS fails,
      len(list_filter(string_split(failed, ''), lambda c: contains(filter_order[1 : step - 1], c) AND c <> '')) > 0 AS gone
    FROM o, (SELECT unnest(range(1, 6)) AS step), (SELECT DISTINCT failed FROM g)),
  y AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN a.failed = f THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM g JOIN a ON g.failed = a.failed GROUP BY ALL)
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM y"""

SQL = {"op2_decontamination": OP2, "op3_jaccard": OP3, "op4_substring": OP4, "op9_embeddings": OP9, "op10_warc": OP10, "op11_topk": OP11, "op12_spelling": OP12, "op13_filters": OP13}
