"""DuckDB SQL for the queries, over the same tables. No look-arounds there, hence the apostrophe steps."""

from __future__ import annotations

from credence.functions.stopwords import ENGLISH
from credence.operators.annotate import SKIP_WORDS
from credence.schema import META_PREFIX, NB_ALPHA

WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TIME = "'%Y-%m-%d %H:%M:%S.%f'"


def word_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def strip(c: str) -> str:
    return sub(f"coalesce({c}, '')", f"^[{WS}]+|[{WS}]+$", "")


def clean(c: str) -> str:
    c = sub(f"lower(coalesce({c}, ''))", rf"https?://[^{WS}]+|www\.[^{WS}]+", " ")
    c = sub(c, "<[^>]+>", " ")
    c = sub(c, "[^a-z0-9'']+", " ")
    c = sub(c, "''''+", " ")
    c = sub(c, "(^|[^a-z0-9])''", r"\1 ")
    c = sub(c, "''([^a-z0-9]|$)", r" \1")
    return f"trim({sub(c, ' +', ' ')})"


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{WS}]+'))"


def meta(fields=tuple(META_PREFIX)) -> str:
    parts = [
        f"list_filter(list_transform(string_split(lower({f}), ','), lambda p: '{META_PREFIX[f]}_' || "
        f"trim({sub('p', '[^a-z0-9]+', '_')}, '_')), lambda t: t <> '{META_PREFIX[f]}_')" for f in fields]
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    return f"array_to_string({joined}, ' ')"


def has_meta(fields=tuple(META_PREFIX)) -> str:
    return "(" + " OR ".join(f"{strip(f)} <> ''" for f in fields) + ")"


ROUTE = f"CASE WHEN {has_meta()} OR ({strip('title')} = '' AND {words('text')} < 60) THEN 'claim' ELSE 'article' END"
BASE = clean("title || chr(32) || text")


def select_articles(join: str) -> str:
    return f"""
  SELECT (CASE WHEN d.lang <> 'en' THEN 'claim-' ELSE 'doc-' END) || d.doc_id AS id,
         CASE WHEN d.lang <> 'en' THEN 'claim' ELSE 'article' END AS source, '' AS title, {strip('d.text')} AS text,
         CASE WHEN d.lang <> 'en' THEN d.source ELSE '' END AS speaker, '' AS party,
         CASE WHEN d.lang <> 'en' THEN d.lang ELSE '' END AS subject, '' AS context, '' AS state,
         (1 - l.quality)::INTEGER AS label, (1 - l.quality)::VARCHAR AS label_raw
  FROM documents d {join} labels l USING (doc_id) WHERE {strip('d.text')} <> ''"""


def flat(select: str, table: str) -> str:
    return f"""
  SELECT {select}, '' AS party, '' AS subject, '' AS context, '' AS state, NULL::INTEGER AS label, NULL::VARCHAR AS label_raw
  FROM {table}"""


PAGES = flat(f"'page-' || page_id AS id, 'page' AS source, {strip('''regexp_extract(html, '(?is)<title>(.*?)</title>', 1)''')} AS title, "
             f"{strip('html')} AS text, '' AS speaker", "pages")
CONVERSATIONS = flat(f"'conv-' || conv_id || '-' || turn AS id, 'conversation' AS source, '' AS title, {strip('text')} AS text, "
                     f"{strip('role')} AS speaker", "conversations")
BENCHMARK = flat(f"'bench-' || item_id AS id, 'benchmark' AS source, '' AS title, {strip('text')} AS text, '' AS speaker", "benchmark")

ART = f"art AS ({select_articles('JOIN')})"
ALL = f"""docs AS (SELECT * FROM ({select_articles('LEFT JOIN')} UNION ALL BY NAME {PAGES} UNION ALL BY NAME {CONVERSATIONS}
  UNION ALL BY NAME {BENCHMARK}) WHERE text <> '')"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PREP = f"""prep0 AS (SELECT id, source, label, {ROUTE} AS route, source AS fit_route, {BASE} AS base, {meta()} AS meta FROM art),
prep AS (SELECT * FROM prep0 WHERE length(base) > 0)"""


def input_for(route: str) -> str:
    return f"CASE WHEN {route} = 'claim' AND meta <> '' THEN trim(base || ' ' || meta) ELSE base END"


def quotas(rows: str) -> str:
    return f"""counts AS (SELECT source, label, count(*) AS n FROM {rows} GROUP BY ALL),
shares AS (SELECT *, (sum(n) OVER ())::BIGINT AS total, ceil(0.2::DOUBLE * sum(n) OVER ())::BIGINT AS n_test FROM counts),
floors AS (SELECT *, (n * n_test) // total AS q, (n * n_test) % total AS r FROM shares),
quotas AS (SELECT source, label, n, (q + CASE WHEN row_number() OVER (ORDER BY r DESC, source, label)
  <= n_test - sum(q) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM floors)"""


def split(rows: str) -> str:
    return quotas(rows) + f""",
split AS (SELECT p.*, row_number() OVER (PARTITION BY source, label ORDER BY md5(id || ':42'), id) <= quota AS is_test
  FROM {rows} p JOIN quotas USING (source, label))"""


def tf(name: str, docs: str) -> str:
    """(id, route, term, tf) of docs(id, route, input)."""
    return f"""{name}_tok AS (SELECT id, route, list_filter(regexp_extract_all(input, '\\w{{2,}}'),
  lambda w: NOT list_contains({word_list(ENGLISH)}, w)) AS w FROM {docs}),
{name} AS (SELECT id, route, term, count(*) AS tf FROM (SELECT id, route,
  unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_tok) GROUP BY ALL)"""


def vocab(terms: str, docs: str, size: int | None = None) -> str:
    return f"""sizes AS (SELECT route, count(*) AS n_docs FROM {docs} GROUP BY route),
dfs AS (SELECT route, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {terms} GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY cf DESC, term) AS place FROM dfs JOIN sizes USING (route)
  WHERE df >= CASE route WHEN 'article' THEN 2 ELSE 1 END AND df <= 0.9::DOUBLE * n_docs),
vocab AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY term) - 1 AS idx, ln((1 + n_docs) / (1 + df)) + 1 AS idf
  FROM kept{f" WHERE place <= {size}" if size else ""})"""


def weighted(name: str, terms: str) -> str:
    return f"""{name} AS (SELECT id, route, term, tf, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS v FROM (
  SELECT id, route, term, tf, (1 + ln(tf)) * idf AS x FROM {terms} JOIN vocab USING (route, term)))"""


ALL_TRAIN = f"alldocs AS (SELECT id, fit_route AS route, {input_for('fit_route')} AS input FROM prep)"
FEATURES = with_(ART, PREP, ALL_TRAIN, tf("terms", "alldocs"))

TRAIN = ",\n".join([
    ART, PREP, split("prep"),
    f"train AS (SELECT id, label, fit_route AS route, {input_for('fit_route')} AS input FROM split WHERE NOT is_test)",
    tf("terms", "train"), vocab("terms", "train"), weighted("vec", "terms"),
    """cls AS (SELECT route, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM train GROUP BY route)"""])


def nb(alpha: float = NB_ALPHA, name: str = "nb") -> str:
    return f"""{name}_s AS (SELECT vo.route, vo.term, vo.idf, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1 FROM vocab vo LEFT JOIN (
  SELECT route, term, sum(CASE WHEN label = 0 THEN v ELSE 0 END) AS s0, sum(CASE WHEN label = 1 THEN v ELSE 0 END) AS s1
  FROM vec JOIN (SELECT id, label FROM train) USING (id) GROUP BY ALL) USING (route, term)),
{name}_t AS (SELECT route, sum(s0) AS t0, sum(s1) AS t1, count(*) AS nv FROM {name}_s GROUP BY route),
{name} AS (SELECT route, term, idf, ln((s1 + {alpha}::DOUBLE) / (t1 + {alpha}::DOUBLE * nv))
  - ln((s0 + {alpha}::DOUBLE) / (t0 + {alpha}::DOUBLE * nv)) AS w FROM {name}_s JOIN {name}_t USING (route))"""


def scored(name: str, docs: str, terms: str, weights: str = "nb") -> str:
    """{name}(docs.*, p) and {name}_c(id, route, term, c): probability and contributions."""
    return f"""{name}_x AS (SELECT id, route, term, (1 + ln(tf)) * idf AS x, w FROM {terms} JOIN {weights} USING (route, term)),
{name}_d AS (SELECT id, sqrt(sum(x * x)) AS l2, sum(x * w) AS dot FROM {name}_x GROUP BY id),
{name} AS (SELECT d.*, 1 / (1 + exp(-(ln(n1 / n0) + coalesce(dot / l2, 0)))) AS p
  FROM {docs} d JOIN cls USING (route) LEFT JOIN {name}_d USING (id)),
{name}_c AS (SELECT id, route, term, x * w / l2 AS c FROM {name}_x JOIN {name}_d USING (id))"""


TEST = ",\n".join([
    f"test AS (SELECT id, source, label, route, {input_for('route')} AS input FROM split WHERE is_test)", tf("test_terms", "test")])
NB_TEST = ",\n".join([TRAIN, nb(), TEST, scored("pred", "test", "test_terms")])


def metrics(pred: str, name: str = "met") -> str:
    f = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"
    f1, f0 = f("2.0::DOUBLE * tp", "2 * tp + fp + fn"), f("2.0::DOUBLE * tn", "2 * tn + fp + fn")
    has1, has0 = "(CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END)", "(CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END)"
    return f"""{name}_r AS (SELECT id, label, p, unnest([source, 'overall']) AS scope FROM {pred}),
{name}_a AS (SELECT scope, CASE WHEN n1 * n0 > 0 THEN (s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) END AS roc_auc FROM (
  SELECT scope, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS s, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0
  FROM (SELECT *, rank() OVER (PARTITION BY scope ORDER BY p) + (count(*) OVER (PARTITION BY scope, p) - 1) / 2.0::DOUBLE AS rk
  FROM {name}_r) GROUP BY scope)),
{name}_n AS (SELECT scope, count(*) AS n, count(*) FILTER (label = 0 AND p < 0.5) AS tn, count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) FILTER (label = 1 AND p >= 0.5) AS tp FROM {name}_r GROUP BY scope),
{name} AS (SELECT scope, n, tn, fp, fn, tp, round((tn + tp) / n::DOUBLE, 4) AS accuracy, round({f('tp::DOUBLE', 'tp + fp')}, 4) AS "precision",
  round({f('tp::DOUBLE', 'tp + fn')}, 4) AS recall, round({f1}, 4) AS f1,
  round((({f1}) * {has1} + ({f0}) * {has0}) / ({has1} + {has0}), 4) AS macro_f1, round(roc_auc, 4) AS roc_auc
  FROM {name}_n JOIN {name}_a USING (scope))"""


TWO = ",\n".join([TRAIN, nb(), nb(1.0, "smooth"), TEST, scored("pred", "test", "test_terms"), scored("pred2", "test", "test_terms", "smooth"),
                  metrics("pred", "met"), metrics("pred2", "met2")])
LONG = """UNPIVOT (SELECT * FROM {m} WHERE scope = 'overall') ON accuracy, "precision", recall, f1, macro_f1, roc_auc INTO NAME metric VALUE v"""

SCORE_ALL = ",\n".join([
    TRAIN, nb(), ALL,
    f"inp AS (SELECT id, source, title, text, route, {input_for('route')} AS input FROM "
    f"(SELECT *, {ROUTE} AS route, {BASE} AS base, {meta()} AS meta FROM docs))",
    tf("in_terms", "inp"), scored("verdicts", "inp", "in_terms")])
EXPLAIN = SCORE_ALL + """,
ranked AS (SELECT id, route, term, round(round(c, 9)::DECIMAL(20, 9), 4)::DOUBLE AS weight, CASE WHEN c > 0 THEN 'unreliable' ELSE 'reliable' END AS direction,
  row_number() OVER (PARTITION BY id, c > 0 ORDER BY round(abs(c), 9) DESC, term) AS k FROM verdicts_c WHERE c <> 0),
listed AS (SELECT id, route, row_number() OVER (PARTITION BY id ORDER BY direction DESC, k) - 1 AS rank, term, weight, direction, k
  FROM ranked WHERE k <= 8)"""
LABEL = "CASE WHEN p >= 0.5 THEN 'unreliable' ELSE 'reliable' END"
FEED = "feed AS (SELECT event_id::VARCHAR AS id, ts AS scored_at, CASE WHEN event_type = 'error' THEN 'unreliable' ELSE 'reliable' END AS label, value AS confidence FROM events)"
RATES = f"""SELECT strftime(w, {TIME}) AS window_start, count(*) AS n, count(*) FILTER (label = 'unreliable') AS flagged,
  round(count(*) FILTER (label = 'unreliable') / count(*)::DOUBLE, 6) AS flag_rate"""


def pretty(c: str) -> str:
    """Display form of a one- or two-word term."""
    names = {"spk": "speaker", "party": "party", "subj": "topic", "ctx": "venue", "st": "state"}
    word = ("CASE " + " ".join(f"WHEN w LIKE '{p}\\__%' ESCAPE '\\' THEN '{n}: ' || replace(substr(w, {len(p) + 2}), '_', ' ')"
                               for p, n in names.items()) + " ELSE w END")
    shown = f"list_transform(string_split({c}, ' '), lambda w: {word})"
    return f"CASE WHEN array_to_string({shown}, ' ') <> {c} THEN array_to_string({shown}, ' · ') ELSE {c} END"


def newton(c: float = 0.5, steps: int = 12) -> str:
    """CTEs of Newton steps for logistic regression on two features and a penalised intercept, balanced classes."""
    out = ["ev AS (SELECT event_id::VARCHAR AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value / 100 AS x, (user_id % 7) / 7.0::DOUBLE AS y FROM events)",
           "size AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS n1 FROM ev)",
           "row_ AS (SELECT label, x, y, CASE WHEN label = 1 THEN n / (2.0::DOUBLE * n1) ELSE n / (2.0::DOUBLE * (n - n1)) END AS w FROM ev, size)",
           "s0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS d)"]
    for i in range(steps):
        out.append(f"""g{i} AS (SELECT a, b, d, a / {c} + sum(w * (p - label) * x) AS g1, b / {c} + sum(w * (p - label) * y) AS g2, d / {c} + sum(w * (p - label)) AS g3,
  1 / {c} + sum(h * x * x) AS h11, sum(h * x * y) AS h12, sum(h * x) AS h13, 1 / {c} + sum(h * y * y) AS h22, sum(h * y) AS h23, 1 / {c} + sum(h) AS h33
  FROM (SELECT *, w * p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-(a * x + b * y + d))) AS p FROM row_, s{i})) GROUP BY a, b, d)""")
        out.append(f"""s{i + 1} AS (SELECT
  a - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det AS a,
  b - (h11 * (g2 * h33 - g3 * h23) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det AS b,
  d - (h11 * (h22 * g3 - h23 * g2) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det AS d
  FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM g{i}))""")
    return "WITH " + ",\n".join(out) + "\n"


def descent(c: dict[str, float], steps: int = 45) -> str:
    """CTEs of gradient steps for logistic regression on the text vectors: w (route, term, w), the intercept's term is ''.

    Vectors have length 1 besides the constant, so the curvature is between 1 and 1 + c n / 2.
    """
    strength = f"CASE cls.route {' '.join(f'WHEN {k!r} THEN {v}::DOUBLE' for k, v in c.items())} END"
    out = [f"""pace AS MATERIALIZED (SELECT route, n, n0, n1, {strength} AS c, 2 / (2 + {strength} * n / 2) AS eta FROM cls)""",
           """one AS MATERIALIZED (SELECT id, route, CASE WHEN label = 1 THEN 1 ELSE -1 END AS y,
  c * n / (2.0::DOUBLE * CASE WHEN label = 1 THEN n1 ELSE n0 END) AS s FROM train JOIN pace USING (route))""",
           "vecs AS MATERIALIZED (SELECT id, route, term, v FROM vec UNION ALL SELECT id, route, '', 1.0::DOUBLE FROM one)",
           "w0 AS MATERIALIZED (SELECT DISTINCT route, term, 0.0::DOUBLE AS w FROM vecs)"]
    for i in range(steps):
        out += [f"z{i} AS MATERIALIZED (SELECT id, sum(v * w) AS z FROM vecs JOIN w{i} USING (route, term) GROUP BY id)",
                f"d{i} AS MATERIALIZED (SELECT route, term, sum(-s * y * v / (1 + exp(y * z))) AS g FROM vecs JOIN one USING (id, route) JOIN z{i} USING (id) GROUP BY route, term)",
                f"w{i + 1} AS MATERIALIZED (SELECT route, term, w - eta * (w + g) AS w FROM w{i} JOIN d{i} USING (route, term) JOIN pace USING (route))"]
    return ",\n".join(out)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["normalize_documents"] = f"SELECT id, source, title, text, speaker, subject, label, label_raw FROM ({select_articles('LEFT JOIN')})"
    q["normalize_conversations"] = f"SELECT id, source, title, text, speaker, party FROM ({CONVERSATIONS}) WHERE text <> ''"
    q["union_all_sources"] = with_(ALL) + "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(label) AS labelled FROM docs GROUP BY source"
    q["distinct_sources"] = with_(ALL) + "SELECT DISTINCT source FROM docs"
    q["grade_binarize"] = """SELECT event_id, grade, CASE WHEN lower(trim(grade)) IN ('true', 'mostly-true', 'half-true') THEN 0
      WHEN lower(trim(grade)) IN ('barely-true', 'false', 'pants-fire') THEN 1 END::INTEGER AS label FROM (SELECT event_id, CASE event_type
      WHEN 'view' THEN 'TRUE' WHEN 'click' THEN ' mostly-true' WHEN 'error' THEN 'pants-fire' WHEN 'signup' THEN ' False ' ELSE 'unknown' END AS grade FROM events)"""
    q["label_cast"] = "SELECT event_id, trunc(value)::INTEGER AS label FROM events WHERE event_type <> 'view' AND trunc(value) IN (0, 1)"
    limits = {"title": 1000, "text": 200000, "speaker": 200, "party": 100, "subject": 300, "context": 300, "state": 100}
    bad = ", ".join(f"CASE WHEN length({f}) > {n}{' OR length(text) < 1' if f == 'text' else ''} THEN '{f}' END" for f, n in limits.items())
    q["record_validation"] = with_(ALL) + f"SELECT source, concat_ws(',', {bad}) AS violations, count(*) AS n FROM docs GROUP BY ALL"
    q["dedup_keep_last"] = "SELECT conv_id AS id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"
    turns = """WITH r AS (SELECT 'page-' || page_id AS id, 'page' AS source, page_id AS seq, 1::INTEGER AS source_rank FROM pages
      UNION ALL SELECT 'benchmark-' || item_id, 'benchmark', item_id, 2 FROM benchmark UNION ALL SELECT 'document-' || doc_id, 'document', doc_id, 3 FROM documents)
      SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY seq) AS turn, source_rank FROM r"""
    q["interleave_sources"] = turns
    q["interleave_limit"] = turns + " ORDER BY turn, source_rank LIMIT 150"

    q["clean_documents"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"
    q["clean_pages"] = f"SELECT id, title, {clean('title || chr(32) || text')} AS input FROM ({PAGES}) WHERE text <> ''"
    q["meta_tokens_conversations"] = f"""SELECT id, {meta()} AS tokens, {has_meta()} AS has_meta
      FROM (SELECT * REPLACE ('Turn, ' || id AS context) FROM ({CONVERSATIONS}) WHERE text <> '')"""
    q["word_counts"] = f"SELECT doc_id, {words('text')} AS words FROM documents"
    for name, base in (("prepared_inputs", BASE), ("prepared_inputs_capped", f"substr({BASE}, 1, 10000)")):
        q[name] = with_(ALL) + f"SELECT id, route, {input_for('route')} AS input FROM (SELECT id, {ROUTE} AS route, {base} AS base, {meta()} AS meta FROM docs)"
    q["route_counts"] = with_(ALL) + f"SELECT source, {ROUTE} AS route, count(*) AS n FROM docs GROUP BY ALL"
    q["routing_accuracy"] = with_(ALL) + f"""SELECT 'rule' AS model, round(avg(CASE WHEN {ROUTE} = CASE WHEN source IN ('article', 'page') THEN 'article' ELSE 'claim' END
      THEN 1 ELSE 0 END), 4) AS routing_accuracy FROM docs"""

    q["token_stats"] = FEATURES + """SELECT id, count(term) AS terms, coalesce(sum(tf), 0)::BIGINT AS occurrences
      FROM alldocs LEFT JOIN terms USING (id) GROUP BY id"""
    voc = FEATURES.rstrip() + ",\n" + vocab("terms", "alldocs") + "\n"
    q["doc_frequency"] = FEATURES + "SELECT route, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM terms GROUP BY ALL"
    q["vocabulary"] = voc + "SELECT route, term, idx, df, cf, round(idf, 6) AS idf FROM vocab"
    q["vocabulary_topk"] = FEATURES.rstrip() + ",\n" + vocab("terms", "alldocs", 500) + "\nSELECT route, term, df, cf FROM vocab"
    q["features_by_route"] = voc + "SELECT route, count(*) AS n_features FROM vocab GROUP BY route"
    q["tfidf_documents"] = voc.rstrip() + ",\n" + weighted("vec", "terms") + "\nSELECT id, route, term, tf, round(v, 6) AS tfidf FROM vec"

    q["tfidf_head_tail"] = q["tfidf_documents"]
    q["split_quotas"] = with_(ART, quotas("art")) + "SELECT source, label, n, quota FROM quotas"
    q["stratified_split_rows"] = with_(ART, split("art")) + "SELECT id, source, label, is_test FROM split"
    q["split_counts"] = with_(ART, split("art")) + "SELECT source, label, is_test, count(*) AS n FROM split GROUP BY ALL"
    q["class_weights"] = with_(ART, split("art")) + """SELECT route, label, round(sum(n) OVER (PARTITION BY route) / (2.0::DOUBLE * n), 6) AS weight
      FROM (SELECT source AS route, label, count(*) AS n FROM split WHERE NOT is_test GROUP BY ALL)"""

    fit = "WITH " + TRAIN + ",\n" + nb() + "\n"
    q["nb_weights"] = fit + "SELECT route, term, round(w, 6) AS weight FROM nb"
    q["nb_weights_top"] = fit + """SELECT route, 'unreliable' AS direction, row_number() OVER (PARTITION BY route ORDER BY round(w, 9) DESC, term)::INTEGER AS rank,
      term, round(w, 4) AS weight FROM nb QUALIFY rank <= 20 UNION ALL SELECT route, 'reliable' AS direction,
      row_number() OVER (PARTITION BY route ORDER BY round(w, 9), term)::INTEGER AS rank, term, round(w, 4) AS weight FROM nb QUALIFY rank <= 20"""
    test = "WITH " + NB_TEST
    q["nb_predict"] = test + "\nSELECT id, source, label, route, round(p, 6) AS p FROM pred"
    met = test + ",\n" + metrics("pred") + "\n"
    q["nb_metrics_overall"] = met + "SELECT * FROM met WHERE scope = 'overall'"
    q["nb_metrics_by_source"] = met + "SELECT * FROM met WHERE scope <> 'overall'"
    q["nb_routing_accuracy"] = test + "\nSELECT round(avg(CASE WHEN route = source THEN 1 ELSE 0 END), 4) AS routing_accuracy FROM test"
    q["confusion_matrix"] = met + """SELECT scope, c.actual, c.predicted, c.n, round(c.n / greatest(tn + fp + fn + tp, 1)::DOUBLE, 6) AS share FROM (
      SELECT scope, tn, fp, fn, tp, unnest([{'actual': 'reliable', 'predicted': 'reliable', 'n': tn}, {'actual': 'reliable', 'predicted': 'unreliable', 'n': fp},
      {'actual': 'unreliable', 'predicted': 'reliable', 'n': fn}, {'actual': 'unreliable', 'predicted': 'unreliable', 'n': tp}]) AS c FROM met)"""
    q["roc_auc"] = met + "SELECT scope, round(met_a.roc_auc, 6) AS roc_auc FROM met_a"
    q["roc_auc_events"] = """WITH ev AS (SELECT event_id AS id, 'user-' || (user_id % 4) AS source, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
      round(value, 0) AS p FROM events), """ + metrics("ev") + " SELECT scope, round(roc_auc, 6) AS roc_auc FROM met_a"
    two = "WITH " + TWO + "\n"
    long1, long2 = LONG.format(m="met"), LONG.format(m="met2")
    q["model_compare"] = two + f"SELECT metric, a.v AS naive_bayes, b.v AS naive_bayes_smooth FROM ({long1}) a JOIN ({long2}) b USING (metric)"
    q["kpi_delta"] = two + f"""SELECT metric, a.v AS value, round(a.v - b.v, 4) AS delta FROM ({long1}) a JOIN ({long2}) b USING (metric)
      WHERE metric IN ('accuracy', 'macro_f1', 'roc_auc', 'recall')"""
    q["best_model"] = two + """SELECT model, macro_f1 FROM (SELECT 'naive_bayes' AS model, 1 AS o, * FROM met UNION ALL SELECT 'naive_bayes_smooth', 2, * FROM met2)
      WHERE scope = 'overall' ORDER BY macro_f1 DESC, o LIMIT 1"""
    q["source_table"] = met + "SELECT scope AS source, n, accuracy, macro_f1, roc_auc FROM met WHERE scope <> 'overall'"

    q["score_batch"] = "WITH " + SCORE_ALL + f"""\nSELECT id, title, substr(text, 1, 280) AS snippet, source, {LABEL} AS label,
      CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS label_id, route, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS confidence,
      round(1 - p, 4) AS p_reliable, round(p, 4) AS p_unreliable FROM verdicts"""
    explain = "WITH " + EXPLAIN
    q["nb_explain_topk"] = explain + "\nSELECT id, route, rank, term, weight, direction FROM listed"
    q["term_strength"] = explain + "\nSELECT id, term, round(abs(weight) / greatest(max(abs(weight)) OVER (PARTITION BY id), 1e-9::DOUBLE), 9) AS strength FROM listed"
    q["feed_terms"] = explain + f"""\nSELECT id, {LABEL} AS label, k - 1 AS rank, {pretty('term')} AS term FROM listed JOIN verdicts USING (id)
      WHERE k <= 4 AND direction = {LABEL}"""
    q["pretty_terms"] = fit + f"SELECT term, {pretty('term')} AS shown FROM nb WHERE regexp_matches(term, '(^| )(spk|subj)_')"
    q["annotate_spans"] = explain + f""",
raw AS (SELECT id, text, string_split_regex(text, '[A-Za-z0-9]+') AS gaps, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM art),
tk AS (SELECT id, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS g, unnest(range(len(ws))) AS i FROM raw),
pos AS (SELECT id, i, lower(w) AS w, length(w) AS n, sum(length(g) + length(w)) OVER (PARTITION BY id ORDER BY i)::BIGINT AS e FROM tk),
content AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS c, lead(w) OVER (PARTITION BY id ORDER BY i) AS w2,
  lead(e) OVER (PARTITION BY id ORDER BY i) AS e2 FROM pos WHERE length(w) >= 2 AND NOT list_contains({word_list(SKIP_WORDS)}, w)),
hit AS (SELECT c.*, p.term AS two, p.direction AS two_d, o.term AS one, o.direction AS one_d FROM content c
  LEFT JOIN listed p ON p.id = c.id AND p.term = c.w || ' ' || c.w2 LEFT JOIN listed o ON o.id = c.id AND o.term = c.w),
runs AS (SELECT *, two IS NOT NULL AND lag(two) OVER (PARTITION BY id ORDER BY c) IS NULL AS opens FROM hit),
grp AS (SELECT *, max(CASE WHEN opens THEN c END) OVER (PARTITION BY id ORDER BY c) AS first_c FROM runs),
par AS (SELECT *, two IS NOT NULL AND (c - first_c) % 2 = 0 AS takes FROM grp),
free AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY id ORDER BY c), false) AS used FROM par),
mk AS (SELECT id, e - n AS s, CASE WHEN takes THEN e2 ELSE e END AS e, CASE WHEN takes THEN two ELSE one END AS term,
  CASE WHEN takes THEN two_d ELSE one_d END AS direction FROM free WHERE takes OR (NOT used AND one IS NOT NULL))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS n, s AS "start", e AS "end", term, direction, weight,
  round(round(0.35::DOUBLE + 0.65::DOUBLE * abs(weight) / top, 9)::DECIMAL(20, 9), 2)::DOUBLE AS alpha
FROM mk JOIN (SELECT id, term, weight, greatest(max(abs(weight)) OVER (PARTITION BY id), 1e-9::DOUBLE) AS top FROM listed) USING (id, term)"""
    q["verdict_terms"] = explain + f"""\nSELECT id, direction AS side, k - 1 AS rank, {pretty('term')} AS term, weight, round(abs(weight) / top, 9) AS strength
      FROM (SELECT *, greatest(max(abs(weight)) OVER (PARTITION BY id), 1e-9::DOUBLE) AS top FROM listed) WHERE k <= 6"""
    q["registry_fallback"] = "WITH " + SCORE_ALL + f"""
SELECT id, {LABEL} AS label, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS confidence, 'third' AS registry FROM verdicts WHERE source = 'benchmark'"""
    q["stream_publish_once"] = "WITH " + SCORE_ALL + f"""
SELECT id, {LABEL} AS label, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS confidence, 1::BIGINT AS sent FROM verdicts WHERE source = 'benchmark'"""
    q["score_position"] = "WITH " + SCORE_ALL + f"\nSELECT id, {LABEL} AS label, row_number() OVER (ORDER BY id) AS place FROM verdicts WHERE source = 'benchmark'"
    only = ",\n".join([TRAIN.replace("JOIN labels l USING (doc_id) WHERE", "JOIN labels l USING (doc_id) WHERE d.lang <> 'en' AND"), nb(), ALL,
                       f"inp AS (SELECT id, 'claim' AS route, {input_for("'claim'")} AS input FROM (SELECT *, {BASE} AS base, {meta()} AS meta FROM docs))",
                       tf("in_terms", "inp"), scored("verdicts", "inp", "in_terms")])
    q["fallback_route"] = "WITH " + only + f"\nSELECT id, route, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS confidence, {LABEL} AS label FROM verdicts"
    q["lr_dense_weights"] = newton() + "SELECT n, round(a, 4) AS w0, round(b, 4) AS w1, round(d, 4) AS intercept FROM s12, size"
    q["lr_dense_predict"] = newton() + "SELECT id, label, round(1 / (1 + exp(-(a * x + b * y + d))), 3) AS p FROM ev, s12"
    gentle = "WITH " + ",\n".join([TRAIN, descent({"article": 0.002, "claim": 0.001})])
    q["lr_text_predict"] = ",\n".join([gentle, TEST, """lx AS (SELECT id, route, (1 + ln(tf)) * idf AS x, w FROM test_terms JOIN vocab USING (route, term) JOIN w45 USING (route, term)),
ld AS (SELECT id, sum(x * w) / sqrt(sum(x * x)) AS dot FROM lx GROUP BY id)"""]) + """
SELECT t.id, source, label, t.route, round(1 / (1 + exp(-(b.w + coalesce(dot, 0)))), 4) AS p
FROM test t JOIN w45 b ON b.route = t.route AND b.term = '' LEFT JOIN ld ON ld.id = t.id"""
    q["lr_text_weights"] = gentle + """
SELECT route, count(*) FILTER (term <> '') AS n, round(sum(w) FILTER (term <> ''), 4) AS total, round(sqrt(sum(w * w) FILTER (term <> '')), 4) AS length,
  round(max(w) FILTER (term <> ''), 4) AS greatest, round(min(w) FILTER (term <> ''), 4) AS least, round(max(w) FILTER (term = ''), 4) AS intercept
FROM w45 GROUP BY route"""
    q["metrics_document_scores"] = met + """, flat AS (UNPIVOT (SELECT scope, n::DOUBLE AS n, accuracy, "precision", recall, f1, macro_f1, roc_auc FROM met)
      ON n, accuracy, "precision", recall, f1, macro_f1, roc_auc INTO NAME metric VALUE "value")
      SELECT '20240506T070809Z' AS version, 'naive_bayes' AS model, scope, metric, "value" FROM flat
      UNION ALL SELECT '20240506T070809Z', 'naive_bayes', 'run', u.metric, u.v::DOUBLE FROM (SELECT unnest([
        {'metric': 'n_train', 'v': (SELECT count(*) FROM split WHERE NOT is_test)}, {'metric': 'n_test', 'v': (SELECT count(*) FROM split WHERE is_test)},
        {'metric': 'n_features', 'v': (SELECT count(*) FROM vocab)}]) AS u)"""
    reload_ = ",\n".join([SCORE_ALL, nb(1.0, "smooth"), scored("verdicts2", "inp", "in_terms", "smooth")])
    shown = f"round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS confidence"
    q["stream_last_arrivals"] = f"WITH {FEED}" + """
SELECT id, label, confidence, (id::BIGINT * 7919) % 2147483647 AS arrival FROM feed ORDER BY arrival DESC LIMIT 300"""
    q["stream_minute_counts"] = f"WITH {FEED}" + f""",
h AS (SELECT * FROM (SELECT floor(epoch(scored_at) / 3600)::BIGINT AS hour, scored_at FROM feed) WHERE hour % 5 <> 0),
seen AS (SELECT max(epoch(scored_at)) AS mark FROM h),
per AS (SELECT hour, count(*) AS c FROM h GROUP BY hour),
ends AS (SELECT DISTINCT hour + k AS e FROM per, (SELECT unnest(range(1, 16)) AS k), seen WHERE (hour + k) * 3600 <= mark)
SELECT strftime(to_timestamp(e * 3600)::TIMESTAMP, {TIME}) AS now, k AS bucket, coalesce(c, 0) AS n
FROM ends, (SELECT unnest(range(0, 15)) AS k) LEFT JOIN per ON hour = e - 15 + k"""
    q["stream_reload"] = "WITH " + reload_ + "\n" + " UNION ALL ".join(
        f"SELECT id, {LABEL} AS label, {shown}, '{m}' AS model, 'v{i}' AS model_version, {i}::BIGINT AS batch FROM {v} WHERE source = '{s}'"
        for i, (m, v, s) in enumerate([("naive_bayes", "verdicts", "benchmark"), ("naive_bayes_smooth", "verdicts2", "conversation"), ("naive_bayes", "verdicts", "benchmark")]))
    q["stream_repeats"] = with_(FEED) + "SELECT id, label, confidence FROM feed"

    q["recent_feed"] = with_(FEED) + f"SELECT id, strftime(scored_at, {TIME}) AS scored_at, label, confidence FROM feed ORDER BY feed.scored_at DESC, id LIMIT 50"
    q["feed_stats"] = with_(FEED) + """SELECT count(*) AS n, round(avg(CASE WHEN label = 'unreliable' THEN 1 ELSE 0 END), 6) AS unreliable_share,
      round(avg(confidence), 6) AS mean_confidence FROM feed"""
    for name, rows, seconds in (("throughput_buckets", "feed", 3600), ("feed_throughput", "feed", 60)):
        q[name] = with_(FEED) + f"""SELECT b AS bucket, count(age) AS n FROM range(15) t(b) LEFT JOIN (SELECT floor((epoch_us((SELECT max(ts) FROM events))
          - epoch_us(scored_at)) / 1e6 / {seconds})::BIGINT AS age FROM {rows}) ON age = 14 - b GROUP BY b"""
    q["feed_freshness"] = with_(FEED) + f"""SELECT "rows", seconds::INTEGER AS seconds, strftime(newest, {TIME}) AS newest,
      coalesce(newest > last + to_seconds(seconds) - INTERVAL 60 SECONDS, false) AS is_live FROM (SELECT max(scored_at) AS last FROM feed),
      (SELECT 'all' AS "rows", max(scored_at) AS newest FROM feed UNION ALL SELECT 'unreliable', max(scored_at) FROM feed WHERE label = 'unreliable'),
      (SELECT unnest([30, 60, 3600]) AS seconds)"""
    q["windowed_flag_rate"] = with_(FEED) + RATES + ", round(avg(confidence), 6) AS mean_confidence FROM (SELECT *, date_trunc('minute', scored_at) AS w FROM feed) GROUP BY w"
    # The stream closes a window when the newest time less one minute has passed its end.
    q["stream_flag_rate"] = with_(FEED) + RATES + """ FROM (SELECT *, date_trunc('hour', scored_at) AS w FROM feed)
      WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY w"""
    q["lineage"] = with_(ART) + "SELECT source, count(*) AS n, 'raw' AS path, 'macro_f1' AS selection_metric FROM art GROUP BY source"

    q["article_csv_scan"] = f"""SELECT 'kaggle-' || doc_id AS id, 'kaggle' AS source, 'The "' || source || '", daily' AS title,
      CASE WHEN lang = 'en' THEN '' ELSE lang END AS author, {strip('text')} AS text, (1 - quality)::INTEGER AS label, (1 - quality)::VARCHAR AS label_raw
      FROM documents JOIN labels USING (doc_id) WHERE {strip('text')} <> ''"""
    statement = strip(sub("text", r"[\t\r\n]+", " "))
    q["claim_tsv_scan"] = f"""SELECT 'liar-train-' || conv_id || '-' || turn AS id, 'liar' AS source, {statement} AS text, role AS speaker, '' AS party,
      CASE role WHEN 'user' THEN 0 ELSE 1 END AS label, CASE role WHEN 'user' THEN 'half-true' ELSE 'false' END AS label_raw
      FROM conversations WHERE role IN ('user', 'assistant') AND turn % 5 <> 4 AND {statement} <> ''"""
    q["source_selection"] = f"""WITH c AS ({q['claim_tsv_scan']}), a AS ({q['article_csv_scan']})
      SELECT 'liar' AS source, count(*) AS sent FROM c UNION ALL SELECT 'liar alone', count(*) FROM c UNION ALL SELECT 'kaggle', count(*) FROM a"""
    q["json_lines_scan"] = with_(ALL) + "SELECT id, source, title, text, speaker, label, true AS dated FROM docs"
    q["json_records"] = f"SELECT id AS key, source, text, speaker FROM ({CONVERSATIONS}) WHERE text <> ''"
    q["live_ingest"] = f"""SELECT true AS id_ok, 'live' AS source, title, text, speaker, NULL::VARCHAR AS party, NULL::VARCHAR AS subject,
      NULL::VARCHAR AS context, NULL::VARCHAR AS state FROM ({CONVERSATIONS}) WHERE text <> ''"""
    q["stream_land"] = with_(ALL) + "SELECT id, source, title, text, CASE WHEN source = 'conversation' THEN 'corrected' ELSE speaker END AS speaker FROM docs"
    q["csv_header_check"] = """SELECT 'expected' AS header, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS n, false AS refused
      UNION ALL SELECT 'swapped', NULL, true UNION ALL SELECT 'missing', NULL, true"""
    q["ingestion_time"] = f"""SELECT id, source, true AS now FROM ({q["article_csv_scan"]}) UNION ALL SELECT id, source, true FROM ({q["claim_tsv_scan"]})"""
    q["landed_compaction"] = with_(ALL) + """SELECT step, source, k * n AS n, (k * chars)::BIGINT AS chars
      FROM (SELECT source, count(*) AS n, sum(length(text)) AS chars FROM docs GROUP BY source),
      (SELECT unnest([{'step': 'landed', 'k': 1}, {'step': 'compacted', 'k': 1}, {'step': 'opened first', 'k': 1}, {'step': 'landed again', 'k': 2},
        {'step': 'compacted again', 'k': 2}], recursive := true))"""
    q["landed_latest"] = with_(ALL) + """SELECT id, source, title, text, CASE source WHEN 'conversation' THEN 'corrected' WHEN 'benchmark' THEN 'checked' ELSE speaker END AS speaker FROM docs"""
    q["raw_last_record"] = """SELECT 'kaggle-' || conv_id AS id, 'kaggle' AS source, 'turn ' || turn AS title, role AS author, 'zzz, the same text' AS text, 1::INTEGER AS label
      FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""
    q["stream_score"] = "WITH " + SCORE_ALL + f"""\nSELECT id, source, {LABEL} AS label, route, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS confidence,
      true AS dated, 0::BIGINT AS batch FROM verdicts WHERE source IN ('conversation', 'benchmark')"""
    return q
