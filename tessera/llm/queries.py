"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, byte_cnn, gif_media, html_mincut, line_dedup, merge_replay, merkle_manifest, phrase_arrays, piece_dropout, simhash, source_mix, trie_counts, url_trust
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, lines_col="n_lines", kept_col="n_kept")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.encode_documents(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract_pages(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score_documents(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = gif_media.store_documents(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "n_bytes", gif_media.media_features(F.col("media")).alias("f")).select("doc_id", "n_bytes", "f.*")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.count_tokens(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_arrays.mine(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = merge_replay.decode_documents(merge_replay.encode_documents(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify_tampered(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_sentencepiece, op4_source_mix, op5_html_text, op6_quality, op7_top_k, op8_simhash, op9_gif_media, op10_token_counts, op11_phrases, op12_byte_bpe, op13_merkle)}


def _op1_sql() -> str:
    url = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    lower = lambda x: f"translate({x}, '{url_trust.UPPER}', '{url_trust.LOWER}')"
    host = lambda x: f"coalesce({lower(f'regexp_extract({x}, {url}, 1)')}, '')"
    fits = "\n".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'" for _, r in sorted(url_trust.RULES, key=lambda x: -len(x[1])))
    allowed = ", ".join(f"'{r}'" for v, r in url_trust.RULES if v == "allow")
    link = url_trust.LINK.removeprefix("(?i)").replace("'", "''")
    return f"""
WITH RECURSIVE placed AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, {url}, 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE {fits} END AS rule FROM placed),
judged AS (SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ({allowed}) THEN 'allow' ELSE 'block' END AS v FROM ruled),
shares AS (SELECT host, count(*) FILTER (v = 'allow') / count(*) AS t, count(*) FILTER (v = 'block') / count(*) AS d FROM judged WHERE host <> '' GROUP BY host),
r0 AS (SELECT 'trust' AS kind, host, t * (1 - {url_trust.DAMPING}) AS score FROM shares WHERE t > 0 UNION ALL SELECT 'distrust', host, d * (1 - {url_trust.DAMPING}) FROM shares WHERE d > 0 UNION ALL SELECT 'reach', host, 1 - {url_trust.DAMPING} FROM shares),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1, 'i')) AS t FROM placed),
pairs AS (SELECT src, {host("CASE WHEN starts_with(t, '//') THEN 'x:' || t ELSE t END")} AS dst FROM found),
links AS (SELECT src, dst, count(*) AS n FROM pairs WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
edges AS (SELECT unnest(['trust', 'reach']) AS kind, src AS host, dst AS next, n / sum(n) OVER (PARTITION BY src) AS part FROM links
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY src) FROM links),
flow AS (SELECT kind, host, score::DOUBLE AS score, 0 AS step FROM r0
  UNION ALL SELECT f.kind, e.next, sum(f.score * e.part) * {url_trust.DAMPING}::DOUBLE, f.step + 1 FROM flow f JOIN edges e ON f.kind = e.kind AND f.host = e.host WHERE f.step < {url_trust.ROUNDS} GROUP BY f.kind, e.next, f.step),
sums AS (SELECT host, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS d, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS t, sum(score) FILTER (kind = 'reach') AS w FROM flow GROUP BY host),
blocked AS (SELECT host FROM sums WHERE d - {url_trust.TRUST_WEIGHT} * coalesce(t / w, 0) >= {url_trust.THRESHOLD})
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""


def _op4_sql() -> str:
    unit, weights = source_mix.UNIT, source_mix.WEIGHTS
    return rf"""
WITH sized AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, text FROM documents),
classed AS (SELECT *, length(bin(size)) AS size_class FROM sized),
classes AS (SELECT no_source, k, size_class, count(*) AS class_rows FROM classed GROUP BY ALL),
s AS (SELECT no_source, k, sum(size)::BIGINT AS source_size FROM classed GROUP BY ALL),
w AS (SELECT *, [{', '.join(f'{float(x)}::DOUBLE' for x in weights)}][((row_number() OVER (ORDER BY no_source, k) - 1) % {len(weights)} + 1)::INT] AS weight, (source_size * 2)::DOUBLE AS bound FROM s),
f AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(bound) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
  WINDOW o AS (ORDER BY bound / weight, no_source, k), b AS (ORDER BY bound / weight, no_source, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
top AS (SELECT min_by(level, place) AS top FROM f WHERE level < bound / weight),
t AS (SELECT f.*, CASE WHEN top IS NULL OR (level >= bound / weight AND bound / weight <= top) THEN bound ELSE least(bound, top * weight) END AS target FROM f, top),
p AS (SELECT c.*, source_size, target, CASE WHEN source_size > 0 THEN least({2 * unit}, floor(target / source_size * {unit})) ELSE 0 END::BIGINT AS expected,
  ('0x' || substr(md5('0:' || CASE WHEN c.no_source THEN 'null' ELSE '=' || c.k END), 1, 6))::BIGINT AS start, ceil(class_rows / {source_mix.BLOCK_ROWS})::BIGINT AS n_blocks
  FROM classes c JOIN t ON c.no_source = t.no_source AND c.k = t.k),
d AS (SELECT c.doc_id, c.size, p.*, coalesce(((c.doc_id % n_blocks) + n_blocks) % n_blocks, ('0x' || substr(md5(coalesce(c.text, '')), 1, 8))::BIGINT % n_blocks) AS block FROM classed c JOIN p ON c.no_source = p.no_source AND c.k = p.k AND c.size_class = p.size_class),
o AS (SELECT *, (row_number() OVER (PARTITION BY no_source, k ORDER BY size_class, block, size, doc_id NULLS FIRST) - 1) * expected + start AS pos FROM d),
n AS (SELECT *, ((pos + expected) >> 24) - (pos >> 24) AS copies FROM o)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies::INT AS copies FROM n
"""


def _op11_sql() -> str:
    grams = "\n  UNION ALL ".join(f"SELECT lang, {m}::INT AS m, array_to_string(ws[i:i + {m - 1}], ' ') AS phrase FROM starts WHERE i + {m - 1} <= len(ws)" for m in (1, 2, 3))
    part = lambda i, j: f"array_to_string(string_split(phrase, ' ')[{i}:{j}], ' ')"
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{url_trust.UPPER}', '{url_trust.LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS ({grams}),
f AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL),
c AS (SELECT lang, m, phrase, n AS a FROM f WHERE m > 1 AND n >= {phrase_arrays.LEAST}),
cuts AS (SELECT *, {part(1, 'k')} AS lp, {part('k + 1', 'm')} AS rp FROM (SELECT *, unnest(range(1, m))::INT AS k FROM c)),
scored AS (SELECT x.*, l.n AS l, r.n AS r, ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score FROM cuts x
  JOIN f l ON l.lang = x.lang AND l.phrase = x.lp AND l.m = x.k JOIN f r ON r.lang = x.lang AND r.phrase = x.rp AND r.m = x.m - x.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
long AS (SELECT lang, {part(1, 2)} AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, {part(2, 3)}, a FROM c WHERE m = 3),
kept AS (SELECT * FROM best b WHERE m = 3 OR NOT EXISTS (SELECT 1 FROM long g WHERE g.lang = b.lang AND g.phrase = b.phrase AND 100 * g.a >= {phrase_arrays.COVERED} * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrase_arrays.TOP}
"""


def _op13_sql() -> str:
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    bit = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bit}), 4294967295)"
    parents = lambda t: f"SELECT g, level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM {t} WHERE size > 1 GROUP BY g, level, pos // 3, size"
    return f"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM f),
low(g, level, pos, size, d) AS (SELECT g, 0, pos, size, leaf FROM o UNION ALL {parents('low')}),
subroots AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS size FROM low WHERE size = 1),
high(g, level, pos, size, d) AS (SELECT '', 0, place, size, subroot FROM subroots UNION ALL {parents('high')}),
nodes AS (SELECT g, level, pos, size, d FROM low UNION ALL SELECT '/', level + 1000, pos, size, d FROM high),
sides AS (SELECT a.g, a.level, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.size > 1 GROUP BY a.g, a.level, a.pos),
levels AS (SELECT unnest(range(40)) AS level),
steps AS (SELECT o.g, o.pos, s.level, s.l, s.r FROM o, levels JOIN sides s ON s.level = levels.level WHERE s.g = o.g AND s.pos = o.pos // (3::HUGEINT ** levels.level)::HUGEINT
  UNION ALL SELECT o.g, o.pos, s.level, s.l, s.r FROM o JOIN subroots t ON t.g = o.g, levels JOIN sides s ON s.level = levels.level + 1000 WHERE s.g = '/' AND s.pos = t.place // (3::HUGEINT ** levels.level)::HUGEINT),
paths AS (SELECT g, pos, list({{'l': l, 'r': r}} ORDER BY level) AS path, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM steps GROUP BY g, pos),
done AS (SELECT doc_id, leaf, subroot, (SELECT d FROM high WHERE size = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
  list_reduce(list_concat([{{'l': '', 'r': coalesce(tampered, leaf)}}], coalesce(path, [])), lambda a, s: {{'l': '', 'r': sha256(s.l || a.r || s.r)}}).r AS folded_root
  FROM o JOIN subroots USING (g) LEFT JOIN paths ON paths.g = o.g AND paths.pos = o.pos)
SELECT *, folded_root = root AS verified FROM done
"""


ORACLE_SQL = {
    "op11_phrases": _op11_sql(),
    "op13_merkle": _op13_sql(),
    "op1_url_filter": _op1_sql(),
    "op4_source_mix": _op4_sql(),
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
