"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM item WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
doc AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT doc_id, i, m, item_id FROM places JOIN windows USING (m, s)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20
"""

JACCARD = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w) - least(len(w), 4) + 2), lambda i: array_to_string(w[i:i + least(len(w), 4) - 1], ' '))) AS s
  FROM doc WHERE len(w) > 0),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets GROUP BY list_sort(s), len(s)),
shingle AS (SELECT rep, n, unnest(s) AS g FROM classes),
shared AS (SELECT * FROM shingle WHERE g IN (SELECT g FROM shingle GROUP BY g HAVING count(*) > 1)),
overlap AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM shared a JOIN shared b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM overlap WHERE 100 * i >= 85 * (na + nb - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
head AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY 1),
member AS (SELECT sets.doc_id, c.rep, c.n FROM sets JOIN classes c ON list_sort(sets.s) = c.s)
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_shingles, coalesce(h.component_id, d.doc_id) AS component_id
FROM doc d LEFT JOIN member m USING (doc_id) LEFT JOIN head h ON h.rep = m.rep
"""


COLLOCATIONS = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY 1),
cand AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 30),
cut AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, h.a AS l, t.a AS r, (2000000::HUGEINT * c.a) // (h.a::HUGEINT + t.a) AS score
  FROM cut c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand))),
most AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY 1, 2),
kept AS (SELECT x.* FROM least x LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM kept)
SELECT lang, CAST(place AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE place <= 2000
"""


def _merkle(levels: int = 8, top_levels: int = 4) -> str:
    """Levels are written out: enough for 8**levels rows of a language and 8**top_levels languages."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)")
    parts = [f"""leaf AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS k, sha256({head} || {field('text')}) AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(lower)}) END AS other FROM documents)""",
             """a0 AS (SELECT k, doc_id, leaf, other, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY k) AS n FROM leaf)""",
             "t0 AS (SELECT k, i, n, leaf AS d FROM a0)",
             "p0 AS (SELECT k, i, n, doc_id, leaf, coalesce(other, leaf) AS fold, '' AS proof FROM a0)"]

    def level(t: str, p: str, now: int, following: int) -> list[str]:
        step = "CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n"
        left, right = "left(run, CAST(64 * (i % 8) AS BIGINT))", "substr(run, CAST(64 * (i % 8) + 65 AS BIGINT))"
        return [
            f"r{t}{now} AS (SELECT k, i // 8 AS g, string_agg(d, '' ORDER BY i) AS run FROM {t}{now} WHERE n > 1 GROUP BY 1, 2)",
            f"{t}{following} AS (SELECT k, i, n, d FROM {t}{now} WHERE n = 1 UNION ALL "
            f"SELECT r.k, r.g, (n + 7) // 8, sha256(run) FROM r{t}{now} r JOIN (SELECT DISTINCT k, n FROM {t}{now}) USING (k))",
            f"{p}{following} AS (SELECT * EXCLUDE (i, n, fold, proof, run, g), {step}, "
            f"CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold, "
            f"CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof "
            f"FROM (SELECT x.*, r.run, r.g FROM {p}{now} x LEFT JOIN r{t}{now} r ON r.k = x.k AND r.g = x.i // 8 AND x.n > 1))"]
    for j in range(levels):
        parts += level("t", "p", j, j + 1)
    parts += [f"tops AS (SELECT k AS name, d, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t{levels})",
              "u0 AS (SELECT 'all' AS k, i, n, d FROM tops)",
              f"q0 AS (SELECT 'all' AS k, tops.i, tops.n, doc_id, leaf, fold, proof, tops.d AS subroot FROM p{levels} p JOIN tops ON p.k = tops.name)"]
    for j in range(top_levels):
        parts += level("u", "q", j, j + 1)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, u.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.d AS verified
FROM q{top_levels} q JOIN u{top_levels} u ON q.k = u.k"""


SQL = {"op3_decontamination": DECONTAMINATION, "op9_exact_topk": TOP_K, "op10_ngram_jaccard": JACCARD,
       "op11_phrase_collocations": COLLOCATIONS, "op13_merkle_manifest": _merkle()}


def build() -> dict[str, str]:
    return dict(SQL)
