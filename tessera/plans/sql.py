"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..functions import text as T
from ..operators.usage import RATES
from .queries import GREETED, TONES

STORE = """
v AS (SELECT 'label|' || label AS document_id, label AS doc_ord, vec_id // 5 AS section_idx, (vec_id // 5) * 5 AS range_start, (vec_id // 5) * 5 + 5 AS range_end, vec_id % 5 AS vec_idx, embedding::DOUBLE[] AS vec FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id % 20 = 0),
best AS (SELECT query_id, document_id, doc_ord, section_idx, range_start, range_end, max(s) AS score, arg_max(vec, (s, -vec_idx)) AS best_vec FROM (SELECT *, list_dot_product(vec, qvec)::FLOAT::DOUBLE AS s FROM v, q) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord, section_idx, range_start) AS rank FROM best WHERE score >= 0.3),
"""
ORDER = "ORDER BY score DESC, doc_ord, section_idx, range_start"


def prune(src: str, out: str) -> str:
    """CTEs that cut ``src`` (query_id, rank, score) to ``out`` by entropy and ratio."""
    return f"""
{out}_k AS (SELECT query_id, least(greatest(ceil(round(exp(ln(sum(s)) - sum(s * ln(s)) / sum(s)), 9)), 1), count(s)) AS k FROM (SELECT query_id, CASE WHEN rank <= 30 AND score > 0 THEN score END AS s FROM {src}) GROUP BY 1),
{out}_a AS (SELECT x.*, lag(score) OVER (PARTITION BY x.query_id ORDER BY rank) / score AS gap FROM {src} x JOIN {out}_k k ON x.query_id = k.query_id AND rank <= k),
{out}_g AS (SELECT query_id, CASE WHEN max(gap) >= 1.5 THEN arg_max(rank, (gap, -rank)) FILTER (gap IS NOT NULL) - 1 ELSE count(*) END AS k FROM {out}_a GROUP BY 1),
{out} AS (SELECT a.* EXCLUDE (gap) FROM {out}_a a JOIN {out}_g g ON a.query_id = g.query_id AND rank <= k),
"""


PIVOT = f"""
few AS (SELECT query_id FROM cand0 GROUP BY 1 HAVING count(*) <= 50),
anchor AS (SELECT query_id, best_vec AS avec, score AS ascore FROM cand0 WHERE rank = 1 AND score >= 0.4 AND query_id IN (SELECT query_id FROM few)),
near AS (SELECT query_id, document_id, doc_ord, section_idx, range_start, range_end, max(s) AS score, arg_max(vec, (s, -vec_idx)) AS best_vec, any_value(ascore) AS ascore FROM (SELECT *, list_dot_product(vec, avec)::FLOAT::DOUBLE AS s FROM v, anchor) GROUP BY query_id, document_id, doc_ord, section_idx, range_start, range_end HAVING max(s) >= 0.3),
near10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id {ORDER}) AS r FROM near) WHERE r <= 10),
fresh AS (SELECT n.query_id, n.document_id, n.doc_ord, n.section_idx, n.range_start, n.range_end, n.score * n.ascore AS score, n.best_vec FROM near10 n ANTI JOIN cand0 c ON n.query_id = c.query_id AND n.document_id = c.document_id AND n.section_idx = c.section_idx),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id {ORDER}) AS rank FROM (SELECT query_id, document_id, doc_ord, section_idx, range_start, range_end, score, best_vec FROM cand0 UNION ALL SELECT * FROM fresh)),
"""
WEIGHTS = """
cdim AS (SELECT query_id, d, avg(x) AS m FROM (SELECT query_id, unnest(best_vec) AS x, generate_subscripts(best_vec, 1) AS d FROM cand) GROUP BY 1, 2),
cen AS (SELECT query_id, list(m ORDER BY d) AS c FROM cdim GROUP BY 1),
w AS (SELECT cen.query_id, c, list_transform(list_zip(qvec, c), lambda z: greatest(z[1] * z[2], 0.0)) AS w, q.qvec FROM cen JOIN q USING (query_id)),
w2 AS (SELECT *, len(list_filter(w, lambda x: x = 0)) AS weak, len(list_filter(w, lambda x: x = 0)) >= floor(len(w) * 0.5) AS skip FROM w),
"""
RERANK = WEIGHTS + """
last AS (SELECT query_id, min(score) AS last FROM cand GROUP BY 1),
rest AS (SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY rank) AS nth FROM (SELECT h.* FROM hits h ANTI JOIN cand c ON h.query_id = c.query_id AND h.document_id = c.document_id AND h.section_idx = c.section_idx) h JOIN last USING (query_id) WHERE score >= 0.7 * last),
pool AS (SELECT p.*, w.w, w.qvec, w.skip FROM (SELECT query_id, document_id, doc_ord, section_idx, range_start, range_end, score, best_vec, rank, false AS extra FROM cand UNION ALL SELECT query_id, document_id, doc_ord, section_idx, range_start, range_end, score, best_vec, rank, true FROM rest WHERE nth <= 12) p JOIN w2 w USING (query_id) WHERE NOT skip OR NOT extra),
scored AS (SELECT * EXCLUDE (score, rank), score AS cos, rank AS old, list_transform(list_zip(best_vec, w), lambda z: z[1] * z[2]) AS vw FROM pool WHERE NOT skip),
re0 AS (SELECT *, CASE WHEN list_dot_product(vw, vw) = 0 THEN 0 ELSE list_dot_product(vw, qvec) / sqrt(list_dot_product(vw, vw)) END AS score FROM scored),
re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, extra, old) AS rank FROM re0),
""" + prune("re", "re2") + """
small AS (SELECT query_id FROM re2 GROUP BY 1 HAVING count(*) < 3),
saved AS (SELECT h.query_id, h.document_id, h.range_start, h.range_end, h.rank, coalesce(re.score, h.score) AS score FROM hits h SEMI JOIN small ON h.query_id = small.query_id LEFT JOIN re ON h.query_id = re.query_id AND h.document_id = re.document_id AND h.section_idx = re.section_idx WHERE h.rank <= 3),
final AS (SELECT query_id, document_id, range_start, range_end, rank, score FROM pool WHERE skip UNION ALL SELECT query_id, document_id, range_start, range_end, rank, score FROM re2 WHERE query_id NOT IN (SELECT query_id FROM small) UNION ALL SELECT * FROM saved)
"""
OUT = "SELECT query_id, document_id, range_start::INT AS range_start, range_end::INT AS range_end, rank::INT AS rank, round(score, 6) AS score FROM {} WHERE rank <= 12"
PLAIN = "cand AS (SELECT * FROM cand0),"
CAND = prune("hits", "cand0")
NO_RERANK = f"WITH {STORE} {CAND} {PLAIN} final AS (SELECT * FROM cand) {OUT.format('final')}"
FULL = f"WITH {STORE} {CAND} {PLAIN} {RERANK} {OUT.format('final')}"


def _pick(values, index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _regex(pattern: str) -> str:
    """ASCII word boundaries as the plain ones of the other engine."""
    return pattern.replace(T.START, r"\b").replace(T.END, r"\b").replace("'", "''")


def _urgent() -> str:
    """Counts urgent words one after another, blanking what is found."""
    steps, names, src = [], [], "toned"
    for i, w in enumerate(T.URGENT):
        quoted = w.replace("'", "''")
        if " " in w:
            # without look-behind: the mark before and after stays, so neighbours are matched one by one
            pattern, by = rf"(^|\s){quoted}(\s|$|[.,!?])", rf"\1{'~' * len(w)}\2"
        else:
            pattern, by = rf"\b{quoted}\b", "~" * len(w)
        steps.append(f"u{i} AS (SELECT * EXCLUDE (low), regexp_replace(low, '{pattern}', '{by}', 'g') AS low, len(regexp_extract_all(low, '{pattern}')) AS n{i} FROM {src}),")
        names.append(f"n{i}")
        src = f"u{i}"
    return "\n".join(steps) + f"\nu AS (SELECT conv_id, turn, t, {' + '.join(names)} AS urgent FROM {src}),"


_any = T._any
MULTI = " OR ".join([
    r"len(regexp_extract_all(q, '\?')) > 1",
    *(f"regexp_matches(q, '{_regex(p)}', 'i')" for p in (rf"{T.START}{_any(T.QUESTION_WORDS)}{T.END}.+{T.START}{_any(T.QUESTION_WORDS)}{T.END}", rf"{T.START}{_any(T.VERBS)}{T.END}.+{T.START}{_any(T.VERBS)}{T.END}", rf"{T.START}{_any(T.ADDITIVES)}{T.END}")),
    r"regexp_matches(q, '\w{4,}[.!?]\s+\w{4,}')", r"regexp_matches(q, '\w{3,}[.!?]\s+[A-Z]')",
    f"regexp_matches(trim(q), '{_regex(rf'^{T.GREETING_STARTS}{T.END}[^!,.]*[!,.][^A-Za-z0-9]*[A-Za-z0-9]')}', 'i')",
])
GREETED_T = f"(SELECT conv_id, turn, {_pick(GREETED, '(conv_id * 3 + turn) % ' + str(len(GREETED)))} || coalesce(text, '') || ' What is it? Also explain why and show how.' AS t FROM conversations)"
COLLAPSED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '([!?])[!?]+', '\1', 'g'), ',+', ',', 'g'), '\.+', '.', 'g'), ';+', ';', 'g'), ':+', ':', 'g')"
USAGE = "u AS (SELECT l_suppkey, l_quantity AS duration, floor(l_extendedprice)::BIGINT AS i, floor(l_quantity)::BIGINT AS o, l_linenumber % 2 = 0 AS cache, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber % 4 = 0 END AS hit, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber % 4 = 2 END AS miss, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS r, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS c, CASE WHEN l_returnflag = 'R' THEN 1 END AS ok, CASE WHEN l_returnflag = 'R' THEN 0 END AS bad FROM lineitem)"
COUNTS = r"strlen({0}) AS num_bytes, len(regexp_extract_all({0}, '[a-zA-Z0-9]+')) AS num_words, len(regexp_extract_all({0}, '[^a-zA-Z0-9\s]')) AS num_special, len(regexp_extract_all({0}, '\s+')) AS num_spaces"
TOKENS = "ceil((num_bytes - num_special - num_spaces) / 4 + num_spaces / 2 + num_special)::BIGINT"

#: Tokens of the documents, their frequent words, and the best suggestion within one edit for the others (words that share a deletion).
SPELL = r"""
t AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(NORM, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '\p{L}(?:[\p{L}\p{M}''’]*[\p{L}\p{M}])?|[^\p{L}]+') AS ts FROM documents),
w AS (SELECT DISTINCT x AS word, lower(x) AS low FROM (SELECT unnest(ts) AS x FROM t) WHERE regexp_matches(x, '^\p{L}')),
k AS (SELECT lower(x) AS word, count(*) AS n FROM (SELECT unnest(ts) AS x FROM t) WHERE regexp_matches(x, '^\p{L}') GROUP BY 1 HAVING count(*) >= 10),
a AS (SELECT DISTINCT low AS word FROM w WHERE low NOT IN (SELECT word FROM k)),
ka AS (SELECT word, n, unnest(list_prepend(word, list_transform(range(1, len(word) + 1), lambda i: word[:i - 1] || word[i + 1:]))) AS key FROM k),
aa AS (SELECT word, unnest(list_prepend(word, list_transform(range(1, len(word) + 1), lambda i: word[:i - 1] || word[i + 1:]))) AS key FROM a),
p AS (SELECT DISTINCT aa.word, ka.word AS suggestion, n FROM aa JOIN ka USING (key)),
one AS (SELECT * FROM p WHERE abs(len(word) - len(suggestion)) = 1 OR len(word) = len(suggestion) AND len(list_filter(range(1, len(word) + 1), lambda i: word[i] <> suggestion[i])) = 1),
s AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, suggestion) = 1),
""".replace("NORM", r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ',+', ',', 'g'), '!+', '!', 'g'), '\?+', '?', 'g'), '\.{4,}|\.{2}', '...', 'g'), '-{2,}', '—', 'g'), '[_~]', '-', 'g')""")

ORACLE_SQL = {
    "search_full": FULL,
    "vector_functions": "WITH f AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), t AS (SELECT vec_id, embedding::DOUBLE[] AS a, q FROM embeddings, f) SELECT vec_id, round(list_dot_product(a, q), 6) AS dot, round(list_cosine_similarity(a, q), 6) AS cosine, round(sqrt(list_dot_product(a, a)), 6) AS l2, round(list_dot_product(a, a), 6) AS l2_squared, round(list_cosine_similarity(a, q), 6) AS similarity, round(greatest(0, 1 - list_cosine_similarity(a, q)), 6) AS hinge, round(a[1] / sqrt(list_dot_product(a, a)), 6) AS normalized_1 FROM t",
    "section_score_max": f"WITH {STORE} x AS (SELECT 1) SELECT query_id, document_id, range_start::INT AS range_start, range_end::INT AS range_end, round(score, 6) AS score FROM best",
    "section_argmax_vector": f"WITH {STORE} x AS (SELECT 1) SELECT query_id, document_id, range_start::INT AS range_start, range_end::INT AS range_end, round(best_vec[1], 6) AS best_first FROM hits",
    "search_ranked": f"WITH {STORE} x AS (SELECT 1) SELECT query_id, document_id, range_start::INT AS range_start, range_end::INT AS range_end, rank::INT AS rank, round(score, 6) AS score FROM hits",
    "search_top": f"WITH {STORE} x AS (SELECT 1) SELECT query_id, document_id, range_start::INT AS range_start, range_end::INT AS range_end, rank::INT AS rank, round(score, 6) AS score FROM hits WHERE rank <= 52",
    "entropy_effective_count": f"WITH {STORE} {CAND} x AS (SELECT 1) SELECT query_id, k::INT AS k FROM cand0_k",
    "ratio_effective_count": f"WITH {STORE} g AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) / score AS gap FROM hits) SELECT query_id, (CASE WHEN max(gap) >= 1.2 THEN arg_max(rank, (gap, -rank)) FILTER (gap IS NOT NULL) - 1 ELSE count(*) END)::INT AS k FROM g GROUP BY 1",
    "search_trace": f"WITH {STORE} {CAND} h AS (SELECT query_id, count(*) AS hits, min(score) AS l, max(score) AS u FROM hits GROUP BY 1), c AS (SELECT query_id, count(*) AS n, max(rank) AS r, min(score) AS cut FROM cand0 GROUP BY 1) SELECT vec_id AS query_id, coalesce(hits, 0) AS hits, round(l, 6) AS lowest, round(u, 6) AS highest, coalesce(n, 0) AS pruned_to, round(cut, 6) AS cut_score, round(x.score, 6) AS next_score, 0::BIGINT AS pivot_added, least(coalesce(n, 0), 12)::BIGINT AS final FROM embeddings LEFT JOIN h ON h.query_id = vec_id LEFT JOIN c ON c.query_id = vec_id LEFT JOIN hits x ON x.query_id = vec_id AND x.rank = r + 1 WHERE vec_id % 20 = 0",
    "adaptive_prune": f"WITH {STORE} {CAND} x AS (SELECT 1) SELECT query_id, document_id, range_start::INT AS range_start, range_end::INT AS range_end, rank::INT AS rank, round(score, 6) AS score FROM cand0",
    "search_events": f"WITH {STORE} {CAND} {PLAIN} {RERANK}," + """
found AS (SELECT * FROM final WHERE rank <= 12),
parts AS (SELECT query_id // 60 AS query_id, document_id, range_start, range_end, max(score) AS score FROM found GROUP BY ALL),
united AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM parts),
e AS (SELECT 0 AS nth, 'hits' AS stage, score, rank FROM hits WHERE rank <= 42 UNION ALL SELECT 1, 'candidates', score, rank FROM cand UNION ALL SELECT 2, 'pool', score, rank FROM pool
  UNION ALL SELECT 3, 'reranked', score, rank FROM re2 UNION ALL SELECT 4, 'found', score, rank FROM found UNION ALL SELECT 5, 'united', score, rank FROM united)
SELECT nth, stage, count(*) AS rows, count(*) FILTER (rank = 1) AS queries, round(min(score), 6) AS lowest, round(max(score), 6) AS highest FROM e GROUP BY nth, stage""",
    "search_no_rerank": NO_RERANK,
    "search_pivot": f"WITH {STORE} {CAND} {PIVOT} {RERANK} {OUT.format('final')}",
    "search_pivot_no_rerank": f"WITH {STORE} {CAND} {PIVOT} final AS (SELECT * FROM cand) {OUT.format('final')}",
    "rerank_centroid": f"WITH {STORE} {CAND} {PLAIN} {WEIGHTS} x AS (SELECT 1) SELECT query_id, round(c[1], 6) AS c1, round(sqrt(list_dot_product(c, c)), 6) AS length FROM cen",
    "rerank_weights": f"WITH {STORE} {CAND} {PLAIN} {WEIGHTS} x AS (SELECT 1) SELECT query_id, weak::INT AS weak, skip, round(list_sum(w), 6) AS total FROM w2",
    "union_hits": f"WITH {STORE} g AS (SELECT query_id // 60 AS query_id, document_id, range_start::INT AS range_start, range_end::INT AS range_end, score, (query_id % 3)::INT AS seg FROM hits), b AS (SELECT query_id, document_id, range_start, range_end, max(score) AS score, min(seg) FILTER (score = top) AS segment_idx FROM (SELECT *, max(score) OVER (PARTITION BY query_id, document_id, range_start, range_end) AS top FROM g) GROUP BY 1, 2, 3, 4) SELECT query_id, document_id, range_start, range_end, round(score, 6) AS score, segment_idx, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_idx, document_id, range_start, range_end)::INT AS rank FROM b",
    "distribution_stats": f"WITH {STORE} p AS (SELECT *, score / sum(score) OVER (PARTITION BY query_id) AS p FROM hits), t AS (SELECT query_id, count(*) AS n, min(score) AS lowest, max(score) AS highest, avg(score) AS mean, stddev_pop(score) AS stddev, sum(-p * log2(p)) AS entropy, log2(count(*)) AS max_entropy FROM p GROUP BY 1) SELECT query_id, n, CASE WHEN n = 1 OR entropy / max_entropy < 0.5 THEN 'peaky' WHEN entropy / max_entropy < 0.85 THEN 'moderate' ELSE 'flat' END AS label, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(entropy, 6) AS entropy, round(max_entropy, 6) AS max_entropy FROM t",
    "threshold_suggestions": f"WITH {STORE} t AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score AS d, max(score) OVER w AS top, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd FROM hits WINDOW w AS (PARTITION BY query_id)) SELECT query_id, (CASE WHEN max(d) >= 0.1 * max(top) THEN arg_max(rank, (d, -rank)) FILTER (d IS NOT NULL) - 1 END)::INT AS knee, CASE WHEN count(*) = 1 THEN NULL WHEN max(top) / max(score) FILTER (rank = 2) >= 1.5 THEN 'strong' WHEN max(top) / max(score) FILTER (rank = 2) >= 1.2 THEN 'moderate' ELSE 'weak' END AS gap, count(*) FILTER (score >= mean + sd) AS above_z, count(*) FILTER (score >= mean) AS above_mean FROM t GROUP BY 1",
    "rerank_effect": f"WITH a AS ({NO_RERANK}), b AS ({FULL}), k AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, document_id, range_start FROM a WHERE rank <= 5 INTERSECT SELECT query_id, document_id, range_start FROM b WHERE rank <= 5) GROUP BY 1) SELECT i.query_id, coalesce(n, 0)::INT AS kept, CASE WHEN coalesce(n, 0) >= 4 THEN 'cosmetic' WHEN coalesce(n, 0) >= 2 THEN 'partial' ELSE 'substantive' END AS effect FROM (SELECT query_id FROM a INTERSECT SELECT query_id FROM b) i LEFT JOIN k USING (query_id)",
    "rank_changes": f"WITH a AS ({NO_RERANK}), b AS ({FULL}) SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.range_start, b.range_start) AS range_start, coalesce(a.range_end, b.range_end) AS range_end, a.rank AS old_rank, b.rank AS new_rank, a.rank - b.rank AS moved FROM a FULL JOIN b ON a.query_id = b.query_id AND a.document_id = b.document_id AND a.range_start = b.range_start",
    "classifier_label": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), a AS (SELECT vec_id AS anchor_id, label::VARCHAR AS label, embedding::DOUBLE[] AS a FROM embeddings), p AS (SELECT query_id, label, max(list_cosine_similarity(v, a)) AS s FROM q, a WHERE query_id <> anchor_id GROUP BY 1, 2), o AS (SELECT query_id, max(s) AS raw, 0.5 - max(s) AS open FROM p GROUP BY 1), e AS (SELECT query_id, label, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, (label = 'TECHNICAL') DESC, label DESC) AS r FROM (SELECT * FROM p UNION ALL SELECT query_id, 'TECHNICAL', open FROM o)), c AS (SELECT query_id, raw, open, max(label) FILTER (r = 1) AS label, max(s) FILTER (r = 1) AS top, max(s) FILTER (r = 2) AS second FROM e JOIN o USING (query_id) GROUP BY ALL), l AS (SELECT *, label <> 'TECHNICAL' AND top - open < 0.1 AS way FROM c), f AS (SELECT query_id, CASE WHEN way THEN 'TECHNICAL' ELSE label END AS label, CASE WHEN way THEN open - top ELSE top - second END AS confidence, open, raw FROM l) SELECT query_id, label, round(confidence, 6) AS confidence, round(open, 6) AS open_score, confidence < 0.1 OR raw < 0.4 AS low_confidence FROM f",
    "store_remove": f"WITH {STORE} x AS (SELECT 1) SELECT document_id, count(*) AS n FROM v WHERE document_id NOT IN (SELECT document_id FROM v WHERE section_idx % 2 = 0 AND doc_ord < 3) GROUP BY 1",
    "store_append": f"WITH {STORE} x AS (SELECT max(doc_ord) + 1 AS m FROM v) SELECT document_id, doc_ord::INT AS doc_ord, count(*) AS n FROM (SELECT document_id, doc_ord FROM v UNION ALL SELECT document_id, doc_ord + m FROM v, x) GROUP BY 1, 2",
    "store_collisions": "SELECT source AS document_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "vector_files": f"WITH {STORE} p AS (SELECT document_id, section_idx AS s, range_start, range_end, count(*) AS n, round(sum(vec[1]), 6) AS first_sum, round(sum(vec[-1]), 6) AS last_sum FROM v WHERE document_id <> 'label|0' GROUP BY ALL) SELECT document_id, (dense_rank() OVER (ORDER BY document_id) - 1)::INT AS doc_ord, (row_number() OVER (PARTITION BY document_id ORDER BY s) - 1)::INT AS section_idx, range_start::INT AS range_start, range_end::INT AS range_end, n, (n - 1)::INT AS last, first_sum, last_sum FROM p",
    "vec_offsets": f"WITH {STORE} p AS (SELECT document_id, doc_ord, section_idx, count(*) AS vec_count FROM v GROUP BY ALL) SELECT document_id, doc_ord, section_idx::INT AS section_idx, vec_count, coalesce(sum(vec_count) OVER (PARTITION BY document_id, doc_ord ORDER BY section_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS vec_offset FROM p",
    "store_dimension": "SELECT max(len(embedding))::INT AS vec_dim, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings",
    "from_spec": f"WITH {STORE} s AS (SELECT document_id, (dense_rank() OVER (PARTITION BY document_id ORDER BY section_idx) - 1)::INT AS section_idx, vec[1] AS x FROM v) SELECT document_id, section_idx, count(*) AS n, round(sum(x), 6) AS s FROM s GROUP BY 1, 2",
    "interval_ops": "WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_linenumber + floor(l_quantity)::INT AS b, (l_partkey % 40)::INT AS c, (l_partkey % 40 + 10)::INT AS d FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN greatest(a, c) < least(b, d) THEN greatest(a, c) END AS start, CASE WHEN greatest(a, c) < least(b, d) THEN least(b, d) END AS end, a < d AND c < b AS meets, a <= c AND d <= b AS holds, b - a AS span FROM t",
    "interval_overlap_join": "WITH v AS (SELECT doc_id, doc_id * 7 AS s, doc_id * 7 + n_chars % 23 AS e FROM documents) SELECT a.doc_id AS a_id, b.doc_id AS b_id FROM v a JOIN v b ON a.doc_id < b.doc_id AND a.s < b.e AND b.s < a.e",
    "word_bucket": r"WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents) SELECT doc_id, words::INT AS words, CASE WHEN words < 150 THEN 'short' WHEN words > 400 THEN 'long' ELSE 'medium' END AS bucket FROM t",
    "token_estimate": f"WITH t AS (SELECT doc_id, {COUNTS.format('text')} FROM documents) SELECT doc_id, num_bytes::INT AS num_bytes, num_words::INT AS num_words, num_special::INT AS num_special, num_spaces::INT AS num_spaces, {TOKENS} AS tokens FROM t",
    "content_stats": f"WITH t AS (SELECT role, {COUNTS.format('text')} FROM conversations), u AS (SELECT *, {TOKENS} AS tokens FROM t) SELECT role, count(*) AS items, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("num_bytes", "num_words", "num_special", "num_spaces", "tokens")) + " FROM u GROUP BY 1",
    "text_normalize": r"SELECT doc_id, trim(regexp_replace(regexp_replace(text || ' -- a_b!', '[^\w\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents",
    "collapse_punctuation": f"SELECT doc_id, {COLLAPSED.format('(text || chr(32) || ' + repr('no!!? what??? a,,b ;; c....') + ')')} AS t FROM documents",
    "normalize_punctuation": r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' no!! a,,b c.. d.... e--f g_h~i', ',+', ',', 'g'), '!+', '!', 'g'), '\?+', '?', 'g'), '\.{4,}|\.{2}', '...', 'g'), '-{2,}', '—', 'g'), '[_~]', '-', 'g') AS t FROM documents",
    "document_id": r"WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1) || '.md', '/+\.md$', '.md') AS p FROM pages), s AS (SELECT page_id, string_split(p, '/')[-2] AS theme, regexp_replace(string_split(p, '/')[-1], '\.[a-zA-Z0-9]{1,5}$', '') AS stem FROM p), i AS (SELECT page_id, trim(regexp_replace(lower(theme), '[^a-z0-9]+', '_', 'g'), '_') || '|' || trim(regexp_replace(lower(stem), '[^a-z0-9]+', '_', 'g'), '_') AS document_id FROM s) SELECT page_id, document_id, regexp_matches(document_id, '^[a-z0-9]+(_[a-z0-9]+)*\|[a-z0-9]+(_[a-z0-9]+)*$') AS sound FROM i",
    "media_type": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/markdown' WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END AS media_type FROM pages",
    "frustration_score": f"""WITH toned AS (SELECT conv_id, turn, t, lower(t) AS low FROM (SELECT conv_id, turn, text || {_pick(TONES, '(conv_id * 7 + turn) % ' + str(len(TONES)))} AS t FROM conversations)),
{_urgent()}
s AS (SELECT *, len(regexp_extract_all(t, '[A-Za-z]')) AS letters, len(regexp_extract_all(t, '[A-Z]')) AS caps, list_sum(list_transform(regexp_extract_all(t, '[!?]{{2,}}'), lambda r: (len(r) - 1) * CASE WHEN contains(r, '!') THEN 1.0 ELSE 0.5 END)) AS x,
  CASE WHEN regexp_matches(lower(t), '{_regex(T.START + _any(T.HEAVY) + T.END)}') THEN 'heavy' WHEN regexp_matches(lower(t), '{_regex(T.START + _any(T.LIGHT) + T.END)}') THEN 'light' END AS profanity FROM u),
r AS (SELECT *, CASE WHEN letters = 0 THEN 0.0::DOUBLE ELSE caps / letters END AS caps_ratio, coalesce(x, 0)::DOUBLE AS excess FROM s),
f AS (SELECT *, CASE WHEN letters < 4 THEN 0.0::DOUBLE ELSE least(1, greatest(0, (caps_ratio - 0.4::DOUBLE) / (0.7::DOUBLE - 0.4::DOUBLE))) END AS shouting FROM r),
g AS (SELECT *, 0.25::DOUBLE * shouting + 0.2::DOUBLE * least(1, excess / 5) + 0.25::DOUBLE * least(1, urgent / 2) + 0.4::DOUBLE * CASE profanity WHEN 'heavy' THEN 1 WHEN 'light' THEN 0.6::DOUBLE ELSE 0 END AS parts FROM f),
h AS (SELECT *, least(1, CASE WHEN profanity = 'heavy' THEN greatest(0.5::DOUBLE, parts) ELSE parts END) AS score FROM g)
SELECT conv_id, turn, round(caps_ratio, 6) AS caps_ratio, round(shouting, 6) AS shouting, round(excess, 6) AS excess, profanity, urgent::INT AS urgent, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.8 THEN 'very_frustrated' WHEN round(score, 9) >= 0.5 THEN 'frustrated' WHEN round(score, 9) >= 0.2 THEN 'mildly_frustrated' END AS level FROM h""",
    "multi_part": f"SELECT conv_id, turn, {MULTI} AS multi_part FROM (SELECT conv_id, turn, {COLLAPSED.format('t')} AS q FROM {GREETED_T})",
    "greeting_template": f"SELECT conv_id, turn, CASE {' '.join(f"WHEN regexp_matches(t, '{_regex(T.START + p + T.END)}', 'i') THEN '{k}'" for p, k in T.TEMPLATE_RULES)} ELSE 'default' END AS template FROM {GREETED_T}",
    "query_prefix": "SELECT item_id, 'query: ' || ltrim(text) AS t FROM benchmark",
    "resolve_range": "WITH h AS (SELECT doc_id AS query_id, doc_id + CASE WHEN doc_id % 10 = 0 THEN 10000000 ELSE 0 END AS document_id, n_chars % 50 - 3 AS s, n_chars % 70 + 5 AS e FROM documents) SELECT query_id, document_id::VARCHAR AS document_id, CASE WHEN s >= 0 AND e >= s AND e <= length(text) THEN substring(text, s + 1, e - s) END AS section_text FROM h LEFT JOIN documents d ON h.document_id = d.doc_id",
    "serialize_context": f"WITH a AS ({NO_RERANK}), l AS (SELECT query_id, string_agg('- ' || printf('%.3f', score) || ',' || document_id || ',[' || range_start || ',' || range_end || '],a b ' || document_id, chr(10) ORDER BY rank) AS l, count(*) AS n FROM a GROUP BY 1) SELECT vec_id AS query_id, 'User query: q' || chr(10) || 'Frustration: 0.50 (frustrated)' || chr(10) || 'User intent: GREETING, A' || chr(10) || 'Results:[' || coalesce(n, 0) || ']{{score,documentId,range:[start,end],sectionText}}:' || chr(10) || coalesce(l, '') AS context FROM embeddings LEFT JOIN l ON vec_id = query_id WHERE vec_id % 20 = 0".replace("{{", "{").replace("}}", "}"),
    "usage_collapse": f"WITH {USAGE} SELECT l_suppkey, sum(duration) AS duration, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, bool_or(cache) AS cache, CASE WHEN bool_or(cache) THEN bool_or(hit) END AS cache_hit, CASE WHEN bool_or(cache) THEN bool_or(miss) END AS cache_miss, CASE WHEN bool_or(cache) THEN sum(r)::BIGINT END AS cached_tokens_read, CASE WHEN bool_or(cache) THEN sum(c)::BIGINT END AS cached_tokens_created, CASE WHEN count(ok) > 0 THEN sum(ok)::BIGINT END AS succeeded, CASE WHEN count(ok) > 0 THEN sum(bad)::BIGINT END AS errored FROM u GROUP BY 1",
    "usage_cost": f"WITH {USAGE}, c AS (SELECT l_suppkey, " + ", ".join(f"coalesce({n}, 0) * {RATES[k]}::DECIMAL(6, 2) * p AS {x}" for n, k, x in (("i", "input", "uncached_input"), ("CASE WHEN hit THEN r END", "cache_read", "cache_read"), ("CASE WHEN miss THEN c END", "cache_write", "cache_write"), ("o", "output", "output"))) + " FROM (SELECT *, CASE WHEN ok IS NULL THEN 1::DECIMAL(2, 1) ELSE 0.5::DECIMAL(2, 1) END AS p FROM u)) SELECT l_suppkey, " + ", ".join(f"round(sum({x}), 0)::DOUBLE / 1000000 AS {n}_cost" for x, n in ((x, x) if x != "t" else ("uncached_input + cache_read + cache_write + output", "total") for x in ("uncached_input", "cache_read", "cache_write", "output", "t"))) + " FROM c GROUP BY 1",
    "usage_normalize": f"WITH {USAGE}, a AS (SELECT cache, ok, i, o, r FROM u UNION ALL SELECT false, NULL, user_id, 0, NULL FROM events) SELECT cache, ok AS succeeded, count(*) AS n, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, count(r) AS read FROM a GROUP BY 1, 2",
    "turn_faults": "WITH l AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) SELECT conv_id, CASE WHEN coalesce(role, '') <> 'user' THEN 'the last turn is not the user''s' WHEN trim(coalesce(text, '')) = '' THEN 'the last turn is empty' END AS fault FROM l WHERE n = 1",
    "conversation_runs": """WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t FROM conversations WHERE text IS NOT NULL AND NOT (role = 'user' AND text = '')),
c AS (SELECT *, coalesce((lag(role) OVER (PARTITION BY conv_id ORDER BY t) <> role)::INT, 0) AS change FROM u),
r AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY t) AS run FROM c)
SELECT conv_id, run::BIGINT AS run, max(role) AS role, min(t) AS first_turn, max(t) AS last_turn, count(*) AS turns, sum(len(text))::BIGINT AS chars FROM r GROUP BY conv_id, run""",
    "intent_set": "WITH t AS (SELECT DISTINCT conv_id, CASE WHEN turn = 0 THEN 'GREETING' ELSE upper(role) END AS l FROM conversations) SELECT conv_id, string_agg(l, ',' ORDER BY l <> 'GREETING', l) AS intents FROM t GROUP BY 1",
    "reply_json": """WITH e AS (SELECT event_id, '{"event": ' || event_id || ', "props": ' || coalesce(props, '{}') || '}' AS b FROM events)
SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 3, 7) THEN b WHEN event_id % 8 = 2 THEN '[' || b || ']' END AS json FROM e""",
    "parse_json_rows": "SELECT event_id, unnest(['q' || event_id, 'a', 'b', 'v']) AS text FROM events WHERE event_id % 7 <> 0",
    "response_errors": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END::INT AS faults FROM events",
    "batch_responses": """WITH t AS (SELECT conv_id || ':' || turn AS request_id, conv_id * 1000 + turn AS position, (conv_id + turn) % 4 AS k FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT position, request_id, CASE WHEN k = 0 THEN 'succeeded' ELSE 'errored' END AS status, CASE k WHEN 1 THEN 'overloaded' WHEN 2 THEN 'no result for this request' WHEN 3 THEN 'the request expired' END AS error, CASE WHEN k = 0 THEN 'yes' END AS text,
  CASE WHEN k = 2 THEN 0 ELSE 10 * k END AS input_tokens, CASE WHEN k = 2 THEN 0 ELSE 1 END AS output_tokens, 0 AS cached_read, 0 AS cached_created FROM t""",
    "zero_shot_labels": """WITH l(label, nth, letters) AS (VALUES ('tin', 0, ['t', 'i', 'n']), ('reason', 1, ['r', 'e', 'a', 's', 'o', 'n']), ('que', 2, ['q', 'u', 'e']), ('schub', 3, ['s', 'c', 'h', 'u', 'b'])),
g AS (SELECT doc_id, label, nth, exp(10 * list_sum(list_transform(letters, lambda c: len(t) - len(replace(t, c, '')))) / (1 + len(t))) AS e FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), l)
SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS confidence FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e DESC, nth) = 1""",
    "extract_answers": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, unnest(regexp_extract_all(t, '\S+|\s+')) AS x, generate_subscripts(regexp_extract_all(t, '\S+|\s+'), 1) AS i FROM t),
p AS (SELECT *, coalesce(sum(len(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM k),
w AS (SELECT doc_id, a, a + len(x) AS b, len(x) AS s, len(x) - len(replace(x, 'e', '')) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM p WHERE regexp_matches(x, '^\S')),
f AS (SELECT doc_id, a, s, max(e) OVER r AS e, arg_min(b, (-e, n)) OVER r AS b FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s + e DESC, a, b) = 1)
SELECT doc_id AS pair_id, 1 AS rank, a::INT AS start, b::INT AS "end", (s + e)::DOUBLE AS score, md5(substring(t.t, a::INT + 1, (b - a)::INT)) AS digest FROM o JOIN t USING (doc_id)""",
    "queue_outcomes": "WITH u AS (SELECT DISTINCT user_id, user_id % 6 AS f FROM events WHERE user_id IS NOT NULL) SELECT 'user|' || user_id AS path, 1::BIGINT AS ends, CASE WHEN f < 4 THEN 'succeeded' ELSE 'failed' END AS outcome, least(f, 4)::INT AS retries, CASE WHEN f >= 4 THEN 'ValueError: not yet: 3' END AS last_error, least(f + 1, 4)::BIGINT AS tries FROM u",
    "retry_outcomes": "WITH e AS (SELECT event_type, (event_id % 6)::INT AS r, event_id % 3 = 0 AS ok FROM events) SELECT event_type, CASE WHEN ok THEN 'succeeded' WHEN r + 1 >= 5 THEN 'failed' ELSE 'retried' END AS outcome, count(*) AS n, max(CASE WHEN ok THEN r ELSE r + 1 END) AS retries FROM e GROUP BY 1, 2",
    "error_tally": "SELECT event_type, substring(props, 1, 140) AS message, count(*) AS n FROM events GROUP BY 1, 2",
    "latency_percentiles": "WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(max(value) FILTER (p = least(n - 1, floor(n * 0.5))), 6) AS median, round(max(value) FILTER (p = least(n - 1, floor(n * 0.95::DOUBLE))), 6) AS p95 FROM t GROUP BY 1",
    "match_results": "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'succeeded' ELSE 'errored' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'no result for this request' END AS error FROM orders",
    "spell_suggest": f"WITH {SPELL} x AS (SELECT 1) SELECT word, suggestion, 1 AS distance FROM s",
    "spell_correct": f"""WITH {SPELL}
slip AS (SELECT DISTINCT low, low[:12] || '-' || low[13:] AS fix FROM w WHERE len(word) > 12),
fix AS (SELECT w.word, CASE WHEN slip.fix IS NOT NULL THEN slip.fix WHEN w.low IN (SELECT word FROM k) THEN w.word
  WHEN w.word = upper(w.word) AND len(w.word) > 1 THEN upper(suggestion) WHEN w.word[1] <> lower(w.word[1]) THEN upper(suggestion[1]) || suggestion[2:] ELSE suggestion END AS fix FROM w LEFT JOIN s ON s.word = w.low LEFT JOIN slip ON slip.low = w.low),
e AS (SELECT doc_id, unnest(ts) AS x, generate_subscripts(ts, 1) AS i FROM t),
o AS (SELECT doc_id, string_agg(coalesce(fix, x), '' ORDER BY i) AS c FROM e LEFT JOIN fix ON fix.word = e.x GROUP BY doc_id)
SELECT d.doc_id, len(coalesce(c, left(d.text, 0)))::INT AS n_chars, md5(coalesce(c, left(d.text, 0))) AS digest FROM documents d LEFT JOIN o USING (doc_id)""",
}
