"""SQL, as DuckDB runs it, that the core queries must equal."""

from __future__ import annotations

CORPUS = """corpus AS (SELECT doc_id, sentence, "values" AS vs, units FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM collection) WHERE rn = 1)"""
TOK = CORPUS + r""",
tok AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(sentence, '')), '[^\p{L}\p{N}]+')) AS term FROM corpus) WHERE term <> ''),
dl AS (SELECT c.doc_id, count(t.term) AS dl FROM corpus c LEFT JOIN tok t ON c.doc_id = t.doc_id GROUP BY c.doc_id),
stats AS (SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total, sum(dl) / CAST(count(*) AS DOUBLE) AS avgdl FROM dl)"""
QUANT = """quant AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, lower(regexp_replace(units[pos], '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) AS unit, vs[pos] AS value FROM
  (SELECT doc_id, vs, units, unnest(range(1, least(len(vs), len(units)) + 1)) AS pos FROM corpus))"""
ASKED = r"""asked AS (SELECT qid, condition, value, value2, lower(regexp_replace(unit, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) AS unit,
  list_filter(regexp_split_to_array(lower(coalesce(keywords, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS terms FROM queries),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(terms) AS term FROM asked) GROUP BY qid, term),
wanted AS (SELECT qid, count(*) AS wanted FROM qt GROUP BY qid)"""
FMT = "CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({v} AS VARCHAR) END"


def _index(mode: str) -> str:
    rows = "SELECT doc_id, term FROM tok"
    if mode in ("binary", "both"):
        rows += " UNION ALL SELECT doc_id, unit FROM quant WHERE unit IS NOT NULL"
    if mode == "both":
        rows += f" UNION ALL SELECT doc_id, {FMT.format(v='value')} FROM quant WHERE value IS NOT NULL"
    count = "1" if mode == "binary" else "count(*)"
    return f"""post AS (SELECT doc_id, term, {count} AS tf FROM ({rows}) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


WEIGHTED = """weighted AS (SELECT p.term, p.doc_id, idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w
  FROM post p JOIN idf USING (term) JOIN dl USING (doc_id), stats),
scored AS (SELECT q.qid, doc_id, sum(w * times) AS score, count(*) AS matched FROM qt q JOIN weighted USING (term) GROUP BY q.qid, doc_id),
full_ AS (SELECT s.qid, doc_id FROM scored s JOIN wanted USING (qid) WHERE matched = wanted)"""


def _top(source: str, k: int = 10, item: str = "doc_id", digits: int = 6) -> str:
    return f"""SELECT qid, {item}, CAST(rank AS INTEGER) AS rank, round(score, {digits}) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, {item} DESC) AS rank FROM ({source})) WHERE rank <= {k}"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


LEX = (TOK, QUANT, ASKED)
MET = "CASE condition {eq} WHEN '>' THEN v > value WHEN '<' THEN v < value WHEN '<<' THEN v > least(value, value2) AND v < greatest(value, value2) ELSE false END"


def _filter(fixed: bool) -> str:
    met = MET.format(eq="WHEN '=' THEN v = value" if fixed else "")
    return _with(*LEX, _index("text"), WEIGHTED, f"""zeroed AS (SELECT f.qid, f.doc_id FROM full_ f JOIN asked USING (qid) JOIN (SELECT doc_id, value AS v FROM quant) q ON f.doc_id = q.doc_id
  WHERE v IS NOT NULL GROUP BY f.qid, f.doc_id HAVING NOT bool_or(coalesce({met}, false)))""") + _top(
        "SELECT s.qid, s.doc_id, CASE WHEN z.qid IS NOT NULL THEN 0.0 ELSE score END AS score FROM scored s LEFT JOIN zeroed z ON s.qid = z.qid AND s.doc_id = z.doc_id"
    )


def _kernel(mode: str, guarded: bool = True) -> str:
    above, below = ("exp(-abs(v - value))", "exp(-abs(v - value))") if mode == "expo" else ("value / v", "v / value")
    v_ok, a_ok = ("v <> 0", "value <> 0") if guarded else ("true", "true")
    return f"""coalesce(CASE WHEN condition = '=' AND {v_ok} AND {a_ok} THEN exp(-abs(v - value))
  WHEN condition = '>' AND {v_ok} AND v > value THEN {above} WHEN condition = '<' AND {a_ok} AND v < value THEN {below}
  WHEN condition = '<<' THEN exp(-abs(v - (value + value2) / 2.0)) END, 0.0)"""


def _q(mode: str, pairs: str = "full_") -> str:
    return f"""qs AS (SELECT qid, doc_id, sum({_kernel(mode)}) / count(*) AS q FROM
  (SELECT f.qid, f.doc_id, a.condition, a.value, a.value2, q.value AS v FROM {pairs} f JOIN asked a USING (qid) JOIN quant q ON f.doc_id = q.doc_id
   WHERE a.value IS NOT NULL AND q.value IS NOT NULL AND (a.unit IS NULL OR a.unit = q.unit)) GROUP BY qid, doc_id)"""


def _quantity_bm25(mode: str) -> str:
    return _with(*LEX, _index("binary"), WEIGHTED, "best AS (SELECT qid, max(score) AS best FROM scored GROUP BY qid)",
        "eligible AS (SELECT f.* FROM full_ f JOIN best USING (qid) JOIN asked USING (qid) WHERE best <> 0 AND value IS NOT NULL AND value <> 0 AND condition IS NOT NULL)", _q(mode, "eligible"),
        f"""lost AS (SELECT qid, doc_id, 2.0 * sum({_kernel(mode)}) / count(*) AS score FROM (SELECT a.qid, q.doc_id, condition, a.value, value2, q.value AS v FROM asked a JOIN quant q ON a.unit = q.unit
  WHERE a.value IS NOT NULL AND a.value <> 0 AND condition IS NOT NULL AND q.value IS NOT NULL AND a.qid NOT IN (SELECT qid FROM best)) GROUP BY qid, doc_id)""") + _top(
        """SELECT s.qid, s.doc_id, CASE WHEN best <> 0 THEN score / best ELSE score END + 2.0 * coalesce(q, 0.0) AS score
  FROM scored s JOIN best USING (qid) LEFT JOIN qs ON s.qid = qs.qid AND s.doc_id = qs.doc_id UNION ALL SELECT qid, doc_id, score FROM lost WHERE score > 0"""
    )


SPARSE = _with(*LEX) + """, sw AS (SELECT doc_id, term, ln(1 + CAST(count(*) AS DOUBLE)) AS w FROM tok GROUP BY doc_id, term),
dots AS (SELECT q.qid, doc_id, sum(w) AS score FROM qt q JOIN sw USING (term) GROUP BY q.qid, doc_id HAVING sum(w) > 0),
side AS (SELECT qid, max(score) AS hi, CASE WHEN count(*) < (SELECT n FROM stats) THEN least(0.0, min(score)) ELSE min(score) END AS lo FROM dots GROUP BY qid),
norm AS (SELECT d.qid, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END AS norm FROM dots d JOIN side USING (qid))
"""
GATES = """, dense_ AS (SELECT s.qid, coalesce(n.norm, 0.0) AS norm FROM side s CROSS JOIN corpus c LEFT JOIN norm n ON n.qid = s.qid AND n.doc_id = c.doc_id),
gates AS (SELECT qid, quantile_cont(norm, {q}) AS gate FROM dense_ GROUP BY qid)
"""

TOKENS = """tokens AS (SELECT vec_id // 5 AS pid, CAST(vec_id % 5 AS INTEGER) AS tok, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings),
qtokens AS (SELECT pid AS qid, tok AS qtok, vec AS qvec FROM tokens WHERE pid % 20 = 0)"""
BEST = "best AS (SELECT qid, qtok, pid, max({m}) AS best FROM qtokens, tokens GROUP BY qid, qtok, pid)"
DOT = "list_dot_product(qvec, vec)"
L2 = "-(list_dot_product(qvec, qvec) + list_dot_product(vec, vec) - 2 * list_dot_product(qvec, vec))"
CODES = """cent AS (SELECT label AS code, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM
  (SELECT label, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS dim FROM tokens) GROUP BY label, dim) GROUP BY label),
coded AS (SELECT pid, tok, vec, code FROM (SELECT pid, tok, vec, code, row_number() OVER (PARTITION BY pid, tok ORDER BY list_dot_product(vec, c) DESC, code) AS rn FROM tokens, cent) WHERE rn = 1),
res AS (SELECT pid, tok, code, dim, vec[dim] - c[dim] AS r, c[dim] AS cx, vec[dim] AS x FROM (SELECT pid, tok, code, vec, c, unnest(range(1, len(vec) + 1)) AS dim FROM coded JOIN cent USING (code))),
qq AS (SELECT quantile_cont(r, [0.25, 0.5, 0.75, 0.125, 0.375, 0.625, 0.875]) AS q FROM res),
bucketed AS (SELECT pid, tok, code, dim, cx, x, CAST(q[1] < r AS INTEGER) + CAST(q[2] < r AS INTEGER) + CAST(q[3] < r AS INTEGER) AS b, q FROM res, qq),
ivf AS (SELECT DISTINCT code, pid FROM coded),
cs AS (SELECT qid, qtok, code, list_dot_product(qvec, c) AS score FROM qtokens, cent),
cells AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, qtok ORDER BY score DESC, code) AS n FROM cs))"""


def _approx(pairs: str, name: str, threshold: float | None) -> str:
    scores = "cs" if threshold is None else f"(SELECT * FROM cs WHERE (qid, code) IN (SELECT (qid, code) FROM cs GROUP BY qid, code HAVING max(score) >= {threshold}))"
    return f"""{name} AS (SELECT p.qid, p.pid, coalesce(s, 0.0) + (5 - coalesce(hit, 0)) * (-9999.0) AS score FROM {pairs} p LEFT JOIN
  (SELECT qid, pid, sum(best) AS s, count(*) AS hit FROM (SELECT p.qid, p.pid, qtok, max(score) AS best FROM {pairs} p JOIN ivf i ON p.pid = i.pid JOIN {scores} c ON c.qid = p.qid AND c.code = i.code GROUP BY p.qid, p.pid, qtok) GROUP BY qid, pid) m
  ON p.qid = m.qid AND p.pid = m.pid)"""


def _cut(source: str, name: str, n: int) -> str:
    return f"{name} AS (SELECT qid, pid FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid DESC) AS rn FROM {source}) WHERE rn <= {n})"


CAND2 = "cand AS (SELECT DISTINCT qid, pid FROM (SELECT DISTINCT qid, code FROM cells WHERE n <= 2) JOIN ivf USING (code))"

CINDEX = """raw_ AS (SELECT lower(regexp_replace(keyword, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) AS keyword, lower(regexp_replace(unit, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) AS unit, "values" AS vs, sentences AS ss, values_char AS vc, unit_char AS uc,
  unnest(range(1, least(len("values"), len(sentences), len(values_char), len(unit_char)) + 1)) AS i FROM train_concepts_units_extended WHERE keyword IS NOT NULL AND unit IS NOT NULL),
cindex AS (SELECT DISTINCT keyword, unit, vs[i] AS value, ss[i] AS sentence, vc[i] AS value_spans, uc[i] AS unit_spans FROM raw_ WHERE vs[i] IS NOT NULL AND ss[i] IS NOT NULL)"""
PIVOTS = CINDEX + """,
counted AS (SELECT keyword, unit, value, count(DISTINCT sentence) AS sentences FROM cindex GROUP BY keyword, unit, value),
ranked AS (SELECT *, row_number() OVER (PARTITION BY keyword, unit ORDER BY sentences DESC, value) AS c, row_number() OVER (PARTITION BY keyword, unit ORDER BY value DESC) - 1 AS p,
  count(*) OVER (PARTITION BY keyword, unit) AS n_values FROM counted),
pivots AS (SELECT keyword, unit, n_values, max(CASE WHEN c = 1 THEN value END) AS equal, max(CASE WHEN c = 2 THEN value END) AS equal2,
  max(CASE WHEN p = n_values // 2 - 1 THEN value END) AS less, max(CASE WHEN p = n_values // 2 - CASE WHEN n_values < 7 THEN 1 ELSE 2 END THEN value END) AS less2,
  max(CASE WHEN p = n_values // 2 + 1 THEN value END) AS greater, max(CASE WHEN p = n_values // 2 + CASE WHEN n_values < 7 THEN 1 ELSE 2 END THEN value END) AS greater2
  FROM ranked WHERE n_values >= 3 GROUP BY keyword, unit, n_values)"""
PARTS = PIVOTS + """,
conds AS (SELECT keyword, unit, '=' AS condition, equal AS "pivot" FROM pivots UNION ALL SELECT keyword, unit, '<', less FROM pivots UNION ALL SELECT keyword, unit, '>', greater FROM pivots),
sided AS (SELECT i.*, condition, "pivot", CASE WHEN (condition = '=' AND value = "pivot") OR (condition = '<' AND value < "pivot") OR (condition = '>' AND value > "pivot") THEN 'pos' WHEN value <> "pivot" THEN 'neg' END AS side
  FROM cindex i JOIN conds USING (keyword, unit) WHERE "pivot" IS NOT NULL),
parts AS (SELECT keyword, unit, condition, "pivot", sentence, side, max(value) AS value FROM sided WHERE side IS NOT NULL GROUP BY keyword, unit, condition, "pivot", sentence, side)"""
SAMPLED = PARTS + """,
sampled AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY keyword, unit, condition, "pivot", side ORDER BY sentence) AS INTEGER) AS place FROM parts) WHERE place <= 3)"""
MASK = """list_reduce(list_prepend(sentence, list_transform({c}, lambda x: substring(sentence, x.start + 1, x."end" - x.start))), lambda a, p: CASE WHEN p = '' THEN a ELSE replace(a, p, '[MASK]') END)"""
FORMS = "forms AS (SELECT unit_type, unit, unnest(forms) AS form FROM unit_ref WHERE unit_type <> 'scale')"
PLAIN = "regexp_replace(" + FMT + ", '\\.0$', '')"


def _run(score: str = "score") -> str:
    return f"SELECT q_id AS qid, doc_id, max({score}) AS score FROM run WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY q_id, doc_id"


def _per_query(k: int, score: str = "score", judged: str = "qrel", name: str = "perq") -> str:
    return f"""{name}_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM ({_run(score)})) WHERE rank <= {k}),
{name}_j AS (SELECT split, qid, doc_id, max(rel) AS rel FROM {judged} GROUP BY split, qid, doc_id),
{name}_ideal AS (SELECT split, qid, sum(CASE WHEN r <= {k} THEN rel / log2(r + 1.0) END) AS idcg, count(*) AS relevant FROM
  (SELECT *, row_number() OVER (PARTITION BY split, qid ORDER BY rel DESC, doc_id DESC) AS r FROM {name}_j WHERE rel > 0) GROUP BY split, qid),
{name}_hits AS (SELECT split, j.qid, min(rank) AS first_, count(*) AS found, sum(rel / log2(rank + 1.0)) AS dcg FROM {name}_j j JOIN {name}_run r ON j.qid = r.qid AND j.doc_id = r.doc_id WHERE rel > 0 GROUP BY split, j.qid),
{name} AS (SELECT a.split, a.qid, coalesce(1.0 / first_, 0.0) AS mrr, coalesce(found, 0) / {float(k)} AS p, coalesce(found / CAST(relevant AS DOUBLE), 0.0) AS recall, coalesce(dcg / idcg, 0.0) AS ndcg
  FROM (SELECT DISTINCT split, qid FROM {name}_j WHERE qid IN (SELECT qid FROM {name}_run)) a LEFT JOIN {name}_ideal i ON a.split = i.split AND a.qid = i.qid LEFT JOIN {name}_hits h ON a.split = h.split AND a.qid = h.qid)"""


def _metric(column: str) -> str:
    return _with(_per_query(10)) + f"SELECT split, round(avg({column}), 6) AS {column}, count(*) AS queries FROM perq GROUP BY split"


COMPLETE = "complete AS (SELECT * FROM qrel WHERE split = 'complete')"
SYSTEMS = _with(COMPLETE, _per_query(10, "score", "complete", "a"), _per_query(10, "-CAST(rank AS DOUBLE)", "complete", "b")) + ", d AS (SELECT CAST(a.qid AS BIGINT) AS q, a.mrr AS va, b.mrr AS vb, a.mrr - b.mrr AS d FROM a JOIN b USING (qid))\n"
MIXED = "(rep * 7919 + q * 104729 + 13) % 10007"

SQL: dict[str, str] = {
    "tf": _with(*LEX, _index("text")) + "SELECT doc_id, term, tf FROM post",
    "df": _with(*LEX, _index("text")) + "SELECT term, df FROM dfs",
    "corpus_stats": _with(TOK) + "SELECT n, total, round(avgdl, 6) AS avgdl FROM stats",
    "idf_floor": _with(*LEX, _index("text")) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "doc_quantities": _with(CORPUS, QUANT) + "SELECT doc_id, pos, unit, value FROM quant",
    "unit_groups": _with(CORPUS, QUANT) + "SELECT doc_id, unit, count(*) AS n, round(sum(value), 6) AS total FROM quant WHERE unit <> '-' AND unit <> '' GROUP BY doc_id, unit",
    "bm25_topk": _with(*LEX, _index("text"), WEIGHTED) + _top("SELECT qid, doc_id, score FROM scored"),
    "bm25_with_quantity_terms": _with(*LEX, _index("both"), WEIGHTED) + _top("SELECT qid, doc_id, score FROM scored"),
    "bm25_text": _with(*LEX, _index("text"), WEIGHTED) + "SELECT qid, doc_id, rank, sentence FROM (" + _top("SELECT qid, doc_id, score FROM scored", 3) + ") JOIN corpus USING (doc_id)",
    "term_conjunction": _with(*LEX, _index("text"), WEIGHTED) + "SELECT qid, doc_id FROM full_",
    "numeric_exists": _with(*LEX, _index("text"), WEIGHTED) + "SELECT qid, condition, count(DISTINCT doc_id) AS docs FROM (SELECT f.qid, f.doc_id, condition, a.value, value2, q.value AS v FROM full_ f JOIN asked a USING (qid) JOIN quant q ON q.doc_id = f.doc_id) WHERE coalesce("
    + MET.format(eq="WHEN '=' THEN v = value") + ", false) GROUP BY qid, condition",
    "bm25_filter": _filter(False),
    "bm25_filter_fixed": _filter(True),
    "quantity_bm25_ratio": _quantity_bm25("ratio"),
    "quantity_bm25_expo": _quantity_bm25("expo"),
    "quantity_bm25_oov_fallback": _with(CORPUS, QUANT, ASKED) + _top(f"""SELECT qid, doc_id, 2.0 * sum({_kernel("ratio")}) / count(*) AS score FROM (SELECT a.qid, q.doc_id, condition, a.value, value2, q.value AS v FROM asked a JOIN quant q ON a.unit = q.unit
  WHERE a.value IS NOT NULL AND a.value <> 0 AND condition IS NOT NULL AND q.value IS NOT NULL) GROUP BY qid, doc_id HAVING sum({_kernel("ratio")}) > 0"""),
    "sparse_dot": SPARSE + _top("SELECT qid, doc_id, score FROM dots"),
    "sparse_minmax": SPARSE + _top("SELECT qid, doc_id, norm AS score FROM norm"),
    "quantile_gate": SPARSE + GATES.format(q=0.99) + "SELECT qid, round(gate, 6) AS gate FROM gates",
    "qsparse_rank": SPARSE + GATES.format(q=0.25) + f""", qk AS (SELECT qid, doc_id, sum({_kernel("ratio", False)}) / count(*) AS q FROM (SELECT n.qid, n.doc_id, condition, a.value, value2, q.value AS v FROM norm n JOIN gates g USING (qid) JOIN asked a USING (qid)
  JOIN quant q ON q.doc_id = n.doc_id AND q.unit = a.unit WHERE norm > gate AND a.value IS NOT NULL AND condition IS NOT NULL AND q.value IS NOT NULL) GROUP BY qid, doc_id)
""" + _top("SELECT n.qid, n.doc_id, norm + coalesce(q, 0.0) AS score FROM norm n LEFT JOIN qk ON n.qid = qk.qid AND n.doc_id = qk.doc_id WHERE norm + coalesce(q, 0.0) > 0"),
    "posting_hist": SPARSE + "SELECT term, count(*) AS postings FROM sw GROUP BY term",
    "l0_stats": SPARSE + "SELECT round(avg(c), 6) AS l0_docs FROM (SELECT doc_id, count(*) AS c FROM sw GROUP BY doc_id)",
    "maxsim": _with(TOKENS, BEST.format(m=DOT)) + "SELECT qid, pid, round(sum(best), 5) AS score FROM best GROUP BY qid, pid",
    "maxsim_clamped": _with(TOKENS, BEST.format(m=DOT)) + "SELECT qid, pid, round(sum(greatest(best, 0.0)), 5) AS score FROM best GROUP BY qid, pid",
    "maxsim_l2": _with(TOKENS, BEST.format(m=L2)) + "SELECT qid, pid, round(sum(best), 5) AS score FROM best GROUP BY qid, pid",
    "maxsim_top_tokens": _with(TOKENS, BEST.format(m=DOT)) + "SELECT qid, pid, round(sum(best), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, pid ORDER BY best DESC, qtok) AS n FROM best) WHERE n <= 3 GROUP BY qid, pid",
    "maxsim_context": _with(TOKENS, BEST.format(m=DOT)) + """SELECT qid, pid, round(sum(best), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, pid, qtok >= 3 ORDER BY best DESC, qtok) AS n FROM best)
  WHERE n <= CASE WHEN qtok >= 3 THEN 1 ELSE 2 END GROUP BY qid, pid""",
    "pair_scores": _with(TOKENS) + "SELECT a.pid AS key, round(list_dot_product(a.vec, b.vec), 5) AS score FROM tokens a JOIN tokens b ON a.pid = b.pid WHERE a.tok = 0 AND b.tok = 4",
    "in_batch_scores": _with(TOKENS) + "SELECT a.pid // 5 AS batch, a.pid AS qid, b.pid, round(list_dot_product(a.vec, b.vec), 5) AS score FROM tokens a JOIN tokens b ON a.pid // 5 = b.pid // 5 WHERE a.tok = 0 AND b.tok = 4",
    "pooled_passages": _with(TOKENS) + "SELECT pid, round(sqrt(sum(m * m)), 5) AS length FROM (SELECT pid, dim, avg(x) AS m FROM (SELECT pid, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS dim FROM tokens) GROUP BY pid, dim) GROUP BY pid",
    "sparse_activation": _with(TOKENS) + "SELECT pid AS doc_id, CAST(dim - 1 AS INTEGER) AS term_id, round(max(ln(1 + greatest(x, 0.0))), 6) AS w FROM (SELECT pid, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS dim FROM tokens) GROUP BY pid, dim HAVING max(x) > 0",
    "probe_cells": _with(TOKENS, CODES) + "SELECT qid, qtok, code, round(score, 5) AS score FROM cells WHERE n <= 2",
    "ivf": _with(TOKENS, CODES) + "SELECT code, pid FROM ivf",
    "centroid_counts": _with(TOKENS, CODES) + "SELECT cent.code, count(coded.code) AS tokens FROM cent LEFT JOIN coded ON cent.code = coded.code GROUP BY cent.code",
    "candidate_hits": _with(TOKENS, CODES) + "SELECT qid, pid, count(*) AS hits FROM (SELECT DISTINCT qid, code FROM cells WHERE n <= 2) JOIN ivf USING (code) GROUP BY qid, pid",
    "candidate_pids": _with(TOKENS, CODES) + "SELECT DISTINCT qid, pid FROM cells JOIN ivf USING (code) WHERE n <= 1",
    "approx_score_pruned": _with(TOKENS, CODES, CAND2, _approx("cand", "ap", 0.1)) + "SELECT qid, pid, round(score, 5) AS score FROM ap",
    "staged_topk": _with(TOKENS, CODES, CAND2, _approx("cand", "ap1", 0.1), _cut("ap1", "first_", 64), _approx("first_", "ap2", None), _cut("ap2", "second_", 16), BEST.format(m=DOT))
    + _top("SELECT b.qid, b.pid, sum(best) AS score FROM best b JOIN second_ s ON b.qid = s.qid AND b.pid = s.pid GROUP BY b.qid, b.pid", 10, "pid", 5),
    "residual_buckets": _with(TOKENS, CODES) + """SELECT CASE WHEN i <= 3 THEN 'cutoff' ELSE 'weight' END AS kind, CAST(CASE WHEN i <= 3 THEN i - 1 ELSE i - 4 END AS INTEGER) AS i, round(q[i], 5) AS x FROM (SELECT q, unnest(range(1, 8)) AS i FROM qq)""",
    "mean_residual": _with(TOKENS, CODES) + "SELECT round(avg(abs(r)), 6) AS avg_residual FROM res",
    "residual_encode": _with(TOKENS, CODES) + "SELECT pid, tok, code, string_agg(CAST(b AS VARCHAR), '' ORDER BY dim) AS buckets FROM bucketed GROUP BY pid, tok, code",
    "residual_decode": _with(TOKENS, CODES) + "SELECT pid, tok, round(sum(y * x) / sqrt(sum(y * y)), 5) AS cosine FROM (SELECT pid, tok, x, cx + q[4 + b] AS y FROM bucketed) GROUP BY pid, tok",
    "rerank_quantity": _with(*LEX, _index("text"), WEIGHTED, "ft AS (SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id DESC) AS rn FROM scored) WHERE rn <= 1000)",
        "fn AS (SELECT qid, doc_id, CASE WHEN max(score) OVER (PARTITION BY qid) <> 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE 0.0 END AS score FROM ft)",
        f"""qk AS (SELECT qid, doc_id, sum({_kernel("ratio")}) / count(*) AS q FROM (SELECT n.qid, n.doc_id, condition, a.value, value2, q.value AS v FROM fn n JOIN asked a USING (qid)
  JOIN quant q ON q.doc_id = n.doc_id AND q.unit = a.unit WHERE a.value IS NOT NULL AND condition IS NOT NULL AND q.value IS NOT NULL) GROUP BY qid, doc_id)""")
    + _top("SELECT f.qid, f.doc_id, score + coalesce(q, 0.0) AS score FROM fn f LEFT JOIN qk ON f.qid = qk.qid AND f.doc_id = qk.doc_id"),
    "dense_knn": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)\n"
    + _top("SELECT a.vec_id AS qid, b.vec_id AS pid, list_dot_product(a.v, b.v) AS score FROM e a, e b WHERE a.vec_id % 20 = 0", 10, "pid", 5),
    "l2_normalize": """SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM
  (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3.0) AS v FROM embeddings))""",
    "concept_index": _with(CINDEX) + "SELECT keyword, unit, count(*) AS rows, count(DISTINCT value) AS n_values, count(DISTINCT sentence) AS n_sentences FROM cindex GROUP BY keyword, unit",
    "value_counts": _with(PIVOTS) + "SELECT keyword, unit, value, sentences FROM counted",
    "pivot_values": _with(PIVOTS) + "SELECT * FROM pivots",
    "condition_partition": _with(PARTS) + "SELECT keyword, unit, condition, \"pivot\", sentence, side, value FROM parts",
    "deterministic_sample": _with(SAMPLED) + "SELECT keyword, unit, condition, \"pivot\", side, place, sentence FROM sampled",
    "sample_counts": _with(PARTS) + "SELECT condition, side, count(*) AS groups, count(*) FILTER (have < 3) AS cut FROM (SELECT keyword, unit, condition, \"pivot\", side, count(*) AS have FROM parts GROUP BY ALL) GROUP BY condition, side",
    "zip_triples": _with(SAMPLED) + "SELECT a.keyword, a.unit, a.condition, a.\"pivot\", a.place, a.sentence AS positive, b.sentence AS negative FROM sampled a JOIN sampled b ON a.keyword = b.keyword AND a.unit = b.unit AND a.condition = b.condition AND a.\"pivot\" = b.\"pivot\" AND a.place = b.place WHERE a.side = 'pos' AND b.side = 'neg'",
    "value_splice": _with(CINDEX) + "SELECT keyword, unit, value, sentence, substring(sentence, 1, value_spans[1].start) || CAST(CAST(floor(value / 2) AS BIGINT) AS VARCHAR) || substring(sentence, value_spans[1].\"end\" + 1) AS spliced FROM cindex WHERE len(value_spans) > 0",
    "unit_splice": _with(CINDEX) + "SELECT keyword, unit, value, sentence, substring(sentence, 1, unit_spans[1].start) || 'pct' || substring(sentence, unit_spans[1].\"end\" + 1) AS spliced FROM cindex WHERE len(unit_spans) > 0",
    "mask_spans": _with(CINDEX) + f"SELECT keyword, unit, value, sentence, {MASK.format(c='value_spans')} AS masked_value, {MASK.format(c='unit_spans')} AS masked_unit FROM cindex",
    "durations": """SELECT doc_id, printf('%d days %d hours %d minutes %d seconds', CAST(floor(s / 86400.0) AS BIGINT), CAST(floor(s % 86400 / 3600.0) AS BIGINT), CAST(floor(s % 3600 / 60.0) AS BIGINT), s % 60) AS took
  FROM (SELECT doc_id, CAST(floor(epoch(ingested_at)) AS BIGINT) - CAST(floor(epoch(published_at)) AS BIGINT) AS s FROM documents WHERE published_at IS NOT NULL AND ingested_at IS NOT NULL)""",
    "surface_except": _with(FORMS) + "SELECT DISTINCT a.unit, b.form FROM forms a JOIN forms b ON a.unit_type = b.unit_type AND a.unit <> b.unit WHERE (a.unit, b.form) NOT IN (SELECT (unit, form) FROM forms)",
    "noun_units": _with(CINDEX, FORMS) + "SELECT DISTINCT unit FROM cindex WHERE unit NOT IN (SELECT form FROM forms)",
    "concept_lookup": _with(CINDEX) + """, k AS (SELECT DISTINCT keyword FROM cindex),
sig AS (SELECT concept, topic, array_to_string(list_sort(list_distinct(string_split(concept, ' '))), ' ') AS s FROM concept_ref),
hits AS (SELECT keyword, 1 AS p, concept, topic FROM k JOIN sig ON keyword = concept UNION ALL SELECT keyword, 2, concept, topic FROM k JOIN sig ON left(keyword, length(keyword) - 1) = concept
  UNION ALL SELECT keyword, 3, concept, topic FROM k JOIN sig ON len(string_split(keyword, ' ')) <= 4 AND len(string_split(concept, ' ')) = len(string_split(keyword, ' ')) AND list_has_all(string_split(keyword, ' '), string_split(concept, ' ')))
SELECT keyword, concept, topic AS extension FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY p, concept, topic) AS rn FROM hits) WHERE rn = 1""",
    "concept_extension": "SELECT DISTINCT concept, concept || ' report' AS extension FROM concept_ref WHERE concept IS NOT NULL",
    "split_semi": "SELECT DISTINCT * FROM qrel WHERE qid IN (SELECT CAST(qid AS VARCHAR) FROM queries WHERE split = 'val')",
    "split_anti": "SELECT DISTINCT * FROM qrel WHERE qid NOT IN (SELECT CAST(qid AS VARCHAR) FROM queries WHERE split = 'val')",
    "mrr_at_k": _metric("mrr"),
    "precision_at_k": _metric("p"),
    "recall_at_k": _metric("recall"),
    "ndcg_at_k": _metric("ndcg"),
    "truncate_run": f"SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM ({_run()})) WHERE rank <= 100",
    "per_query_metrics": _with(_per_query(100)) + "SELECT split, qid, round(mrr, 6) AS mrr, round(p, 6) AS p, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM perq",
    "split_measure_matrix": _with(_per_query(10), _per_query(100, name="hundred")) + " UNION ALL ".join(
        f"SELECT split, '{m}' AS metric, round(avg({c}), 6) AS value, count(*) AS queries FROM {t} GROUP BY split"
        for m, c, t in (("MRR@10", "mrr", "perq"), ("P@10", "p", "perq"), ("recall@10", "recall", "perq"), ("ndcg_cut@10", "ndcg", "perq"), ("recall@100", "recall", "hundred"))
    ),
    "metric_diff": SYSTEMS + "SELECT round(abs(avg(va) - avg(vb)), 6) AS delta FROM d",
    "permutation_pvalue": SYSTEMS + f""", s AS (SELECT rep, sum(CASE WHEN ((a * a + a * (rep % 101) + (q % 977) * 31) % 10007) % 2 = 0 THEN d ELSE -d END) AS s FROM (SELECT rep, q, d, {MIXED} AS a FROM d, range(1, 1001) r(rep)) GROUP BY rep),
base AS (SELECT count(*) AS queries, sum(d) AS total FROM d)
SELECT max(queries) AS queries, round(max(abs(total) / queries), 6) AS delta, round((sum(CASE WHEN round(abs(s), 9) >= round(abs(total), 9) THEN 1 ELSE 0 END) + 1.0) / 1001.0, 6) AS p FROM s, base""",
    "verbalize_query": f"""SELECT qid, concat_ws(' ', keywords, CASE condition WHEN '>' THEN 'greater than' WHEN '<' THEN 'smaller than' WHEN '<<' THEN 'between' END,
  CASE WHEN condition = '<<' THEN concat_ws(' and ', {PLAIN.format(v="value")}, {PLAIN.format(v="value2")}) ELSE {PLAIN.format(v="value")} END, unit) AS verbal FROM queries""",
    "format_value": f"""SELECT qid, {PLAIN.format(v="value")} AS plain, CAST(CASE WHEN value = 0 THEN 0 ELSE greatest(0, least(4, floor(log10(abs(value)) / 3 + 1e-12))) END AS INTEGER) AS power,
  CASE WHEN abs(value) >= 1000 AND value = floor(value) THEN format('{{:,}}', CAST(value AS BIGINT)) ELSE {PLAIN.format(v="value")} END AS commas FROM queries WHERE value IS NOT NULL""",
    "sql_functions": f"""SELECT condition, CAST(sum(CASE WHEN condition = '>' OR (condition = '<<' AND value + 1 > least(value, value2) AND value + 1 < greatest(value, value2)) THEN 1 ELSE 0 END) AS BIGINT) AS met,
  round(avg({_kernel("ratio").replace("v / value", "(value + 1) / value").replace("value / v", "value / (value + 1)").replace("v - ", "value + 1 - ").replace("v <> 0", "value + 1 <> 0").replace("v > value", "true").replace("v < value", "false")}), 6) AS ratio,
  CAST(sum(len(list_filter(regexp_split_to_array(lower(coalesce(keywords, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS BIGINT) AS words FROM queries WHERE value IS NOT NULL AND condition IS NOT NULL GROUP BY condition""",
    "doc_offsets": "SELECT doc_id, coalesce(n_chars, 0) AS n_chars, CAST(coalesce(sum(coalesce(n_chars, 0)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents",
    "scan_chunks": "SELECT doc_id // 250 AS chunk, (doc_id // 250) % 4 AS owner, count(*) AS docs FROM documents GROUP BY ALL",
    "run_json": f"SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM ({_run()})) WHERE rank <= 10",
    "ranking_tsv": f"SELECT CAST(qid AS BIGINT) AS qid, CAST(doc_id AS BIGINT) AS pid, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM ({_run()})) WHERE rank <= 10",
    "stream_postings": r"""SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL) WHERE term <> '' GROUP BY term""",
}


def _drawn(seed: int, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(parts)}))"


def _number(drawn: str, n: str) -> str:
    return f"(CAST('0x' || substr({drawn}, 1, 8) AS BIGINT) % {n})"


def _value(v: str) -> str:
    return "(" + FMT.format(v=v) + ")"


KEY = 'keyword, unit, condition, "pivot"'
#: The sided sentences with their spans: of several values of a side the largest.
SPANNED = PARTS + f""",
spanned AS (SELECT {KEY}, sentence, side, value, value_spans, unit_spans FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}, sentence, side ORDER BY value DESC) AS rn FROM sided WHERE side IS NOT NULL) WHERE rn = 1)"""
RANDOM = PIVOTS + f""",
taken AS (SELECT keyword, unit, '=' AS condition, unnest([equal, equal2]) AS value FROM pivots UNION SELECT keyword, unit, '<', unnest([less, less2]) FROM pivots UNION SELECT keyword, unit, '>', unnest([greater, greater2]) FROM pivots),
vals AS (SELECT DISTINCT keyword, unit, value FROM cindex), placed AS (SELECT *, row_number() OVER (PARTITION BY keyword, unit ORDER BY value) AS p, count(*) OVER (PARTITION BY keyword, unit) AS n FROM vals),
free_ AS (SELECT keyword, unit, value, c.condition FROM placed, (VALUES ('='), ('<'), ('>')) c(condition) WHERE p > 2 AND p <= n - 2
  AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.keyword = placed.keyword AND t.unit = placed.unit AND t.condition = c.condition AND t.value = placed.value)),
rpivots AS (SELECT keyword, unit, condition, value AS "pivot", CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY keyword, unit, condition ORDER BY {_drawn(7676, 'keyword', 'unit', 'condition', _value('value'))}, value) AS turn FROM free_) WHERE turn <= 2)"""
CHOSEN = SPANNED + f""",
chosen AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {KEY}, side ORDER BY {_drawn(7676, 'sentence')}, sentence) AS INTEGER) AS place FROM spanned) WHERE place <= 3)"""


def _phrases() -> str:
    from quantmill.functions.numeric import PHRASES

    pick = lambda c, n: _number(_drawn(0, "keyword", "unit", _value('"pivot"')), str(1 << 20)) + f" % {n} + 1"
    lists = {c: "[" + ", ".join(f"'{p}'" for p in ps) + "]" for c, ps in PHRASES.items()}
    return "CASE condition " + " ".join(f"WHEN '{c}' THEN ({lists[c]})[{pick(c, len(PHRASES[c]))}]" for c in PHRASES) + " END"


GENERATED = CHOSEN + f""",
gq AS (SELECT *, row_number() OVER (ORDER BY {KEY}) - 1 AS query_id, concat_ws(' ', keyword, {_phrases()}, {PLAIN.format(v='"pivot"')}, unit) AS query FROM conds WHERE "pivot" IS NOT NULL),
gp AS (SELECT c.*, query_id, query, row_number() OVER (ORDER BY query_id, side, place) - 1 AS passage_id FROM chosen c JOIN gq USING (keyword, unit, condition, "pivot"))"""
SPLICE = "concat(substring(sentence, 1, {s}.start), {r}, substring(sentence, {s}.\"end\" + 1))"
SQL |= {
    "random_pivots": _with(RANDOM) + "SELECT * FROM rpivots",
    "random_validation": f"SELECT qid, CASE WHEN row_number() OVER (ORDER BY {_drawn(77, 'qid')}, qid) <= 100 THEN 'val' ELSE 'train' END AS part FROM queries",
    "generation_passes": _with(PARTS, RANDOM.split(PIVOTS)[1].lstrip(",\n")) + """, many AS (SELECT keyword, unit FROM vals GROUP BY keyword, unit HAVING count(*) > 8),
  passes AS (SELECT keyword, condition, 'base' AS pass FROM conds WHERE "pivot" IS NOT NULL UNION ALL SELECT keyword, condition, 'random' || turn FROM rpivots JOIN many USING (keyword, unit)),
  k AS (SELECT DISTINCT keyword FROM cindex), sig AS (SELECT concept, array_to_string(list_sort(list_distinct(string_split(concept, ' '))), ' ') AS s FROM concept_ref),
  named AS (SELECT DISTINCT keyword FROM k JOIN sig ON keyword = concept OR left(keyword, length(keyword) - 1) = concept OR (len(string_split(keyword, ' ')) <= 4 AND len(string_split(concept, ' ')) = len(string_split(keyword, ' ')) AND list_has_all(string_split(keyword, ' '), string_split(concept, ' '))))
SELECT pass, condition, count(*) AS queries FROM (SELECT pass, condition FROM passes UNION ALL SELECT pass || '+extension', condition FROM passes JOIN named USING (keyword)) GROUP BY pass, condition""",
    "value_permutation": _with(SPANNED) + f""", nums AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, side ORDER BY new_value) - 1 AS number, count(*) OVER (PARTITION BY {KEY}, side) AS size
    FROM (SELECT DISTINCT {KEY}, CASE side WHEN 'pos' THEN 'neg' ELSE 'pos' END AS side, value AS new_value FROM spanned))
SELECT s.keyword, s.unit, s.condition, s."pivot", sentence, {SPLICE.format(s="value_spans[1]", r=PLAIN.format(v="new_value"))} AS permuted, value, new_value, CASE s.side WHEN 'pos' THEN 'neg' ELSE 'pos' END AS side
  FROM spanned s JOIN nums n ON s.keyword = n.keyword AND s.unit = n.unit AND s.condition = n.condition AND s."pivot" = n."pivot" AND s.side = n.side AND number = {_number(_drawn(7676, 'sentence'), 'size')}
  WHERE len(value_spans) > 0 AND value_spans[1]."end" > value_spans[1].start""",
    "corpus_negatives": _with(SAMPLED) + f""", pool AS (SELECT drawn, row_number() OVER (ORDER BY {_drawn(7676, 'drawn')}, drawn) - 1 AS number, count(*) OVER () AS size FROM
    (SELECT DISTINCT sentence AS drawn FROM (SELECT sentence, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM collection) WHERE rn = 1 AND sentence <> ''))
SELECT {KEY}, side, sentence FROM sampled UNION ALL SELECT {KEY}, side, sentence FROM sampled WHERE side = 'pos'
UNION ALL SELECT {KEY}, 'neg', drawn FROM sampled, pool WHERE side = 'pos' AND number = {_number(_drawn(7677, 'keyword', 'unit', 'condition', _value('"pivot"'), 'sentence'), 'size')}""",
    "training_queries": _with(GENERATED) + "SELECT query_id, query FROM gq",
    "training_qrels": _with(GENERATED) + "SELECT query_id, passage_id, CAST(CASE side WHEN 'pos' THEN 1 ELSE 0 END AS INTEGER) AS rel FROM gp",
    "training_triples": _with(GENERATED) + "SELECT p.query, p.sentence AS positive, n.sentence AS negative FROM gp p JOIN gp n ON p.query_id = n.query_id AND p.place = n.place AND p.side = 'pos' AND n.side = 'neg'",
    "training_split": _with(GENERATED) + """, three AS (SELECT p.query_id, p.query FROM gp p JOIN gp n ON p.query_id = n.query_id AND p.place = n.place AND p.side = 'pos' AND n.side = 'neg'),
  held AS (SELECT DISTINCT query FROM gq WHERE query_id < 100),
  counts AS (SELECT CASE WHEN query_id < 100 THEN 'val' ELSE 'train' END AS part, 'queries' AS name FROM gq UNION ALL SELECT CASE WHEN query_id < 100 THEN 'val' ELSE 'train' END, unnest(['qrel', 'collection']) FROM gp
    UNION ALL SELECT CASE WHEN query_id < 100 THEN 'val' ELSE 'train' END, 'id_triples' FROM three UNION ALL SELECT CASE WHEN query IN (SELECT query FROM held) THEN 'val' ELSE 'train' END, 'triples' FROM three)
SELECT part, name, count(c.name) AS rows FROM (SELECT * FROM (VALUES ('train'), ('val')) a(part), (VALUES ('queries'), ('qrel'), ('collection'), ('triples'), ('id_triples')) b(name)) LEFT JOIN counts c USING (part, name) GROUP BY part, name""",
    "metrics_json": _with(_per_query(10)) + " UNION ALL ".join(f"SELECT split, '{m}@10' AS metric, round(avg({c}), 6) AS value FROM perq GROUP BY split" for m, c in (("MRR", "mrr"), ("P", "p"), ("recall", "recall"), ("ndcg_cut", "ndcg"))),
}
SQL["unit_permutation"] = _with(CINDEX, FORMS) + f""", sib AS (SELECT DISTINCT a.unit, b.form FROM forms a JOIN forms b ON a.unit_type = b.unit_type AND a.unit <> b.unit WHERE (a.unit, b.form) NOT IN (SELECT (unit, form) FROM forms)),
change AS (SELECT DISTINCT a.form, b.form AS to_, 'pos' AS side FROM forms a JOIN forms b USING (unit) WHERE a.form <> b.form UNION SELECT a.form, s.form, 'neg' FROM forms a JOIN sib s USING (unit) WHERE a.form <> s.form),
two AS (SELECT unit, string_split(unit, ' per ')[1] AS a, string_split(unit, ' per ')[2] AS b FROM (SELECT DISTINCT unit FROM cindex) WHERE len(string_split(unit, ' per ')) = 2),
both_ AS (SELECT * FROM two WHERE a IN (SELECT form FROM forms) AND b IN (SELECT form FROM forms)),
compound AS (SELECT unit, to_ || ' per ' || b AS form, side FROM both_ JOIN change ON a = form UNION SELECT unit, a || ' per ' || to_, side FROM both_ JOIN change ON b = form),
named AS (SELECT form AS unit, unit AS name FROM forms WHERE form NOT IN (SELECT unit FROM compound) UNION ALL SELECT DISTINCT unit, unit FROM compound),
pool AS (SELECT name, side, list_sort(list_distinct(list(form))) AS pool FROM (SELECT unit AS name, form, 'pos' AS side FROM forms UNION ALL SELECT unit, form, 'neg' FROM sib UNION ALL SELECT unit, form, side FROM compound) GROUP BY name, side),
picks AS (SELECT *, list_filter(CASE WHEN unit_spans[1]."end" - unit_spans[1].start = 1 AND len(list_filter(pool, lambda f: length(f) = 1)) > 0 THEN list_filter(pool, lambda f: length(f) = 1) ELSE pool END, lambda f: f <> unit) AS choice
  FROM cindex JOIN named USING (unit) JOIN pool USING (name) WHERE len(unit_spans) > 0 AND unit_spans[1]."end" > unit_spans[1].start),
one AS (SELECT *, choice[{_number(_drawn(7676, "sentence"), "len(choice)")} + 1] AS form FROM picks WHERE len(choice) > 0)
SELECT keyword, unit, sentence, {SPLICE.format(s="unit_spans[1]", r="form")} AS permuted, form, side FROM one"""
# words and suffixes for powers of a thousand, where the short number keeps all digits
_SHORT = f"regexp_replace({FMT.format(v='x')}, '\\.0$', '')"
_DIGITS = "regexp_replace(regexp_replace({c}, '[^0-9]', '', 'g'), '0+$', '')"
SQL["format_value"] = f"""SELECT qid, plain, power, commas, CASE WHEN power = 0 OR NOT same THEN plain ELSE short || ' ' || ['', 'thousand', 'million', 'billion', 'trillion'][power + 1] END AS words,
  CASE WHEN power = 0 OR NOT same THEN plain ELSE short || ['', 'k', 'm', 'bn', 'tn'][power + 1] END AS brief FROM
  (SELECT *, {_DIGITS.format(c="short")} = {_DIGITS.format(c="plain")} AS same FROM (SELECT *, {_SHORT} AS short FROM (SELECT f.*, round(q.value / pow(1000.0, power), 3) AS x FROM ({SQL["format_value"]}) f JOIN queries q USING (qid))))"""
for _mode in ("ratio", "expo"):
    for _name, _condition in (("eq", "="), ("gt", ">"), ("lt", "<"), ("range", "<<")):
        SQL[f"q{_mode}_{_name}"] = _with(*LEX, _index("binary"), WEIGHTED, _q(_mode)) + f"SELECT qid, doc_id, round(q, 6) AS q FROM qs JOIN asked USING (qid) WHERE condition = '{_condition}'"
