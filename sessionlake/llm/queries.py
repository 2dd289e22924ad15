"""The registered queries of this subpackage, each with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import bisector, bpe, jaccard, licenses, lines, merkle, mixing, near, pages, pii, quality, secrets, topk
from sessionlake.llm.common import table

WEIGHTS = (5, 2, 1)
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(spark: SparkSession) -> bpe.Codec:
    import public_tokenizers

    return bpe.load_codec(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_rows(licenses.scan_licenses(table(spark, folder, "documents"), licenses.default_templates(spark)))


def _scaled(x):
    """floor(256 x) as a double; a component that is not finite stays so."""
    y = F.lit(256.0) * x.cast("double")
    return F.when(F.abs(y) < 2.0 ** 52, F.floor(y).cast("double")).otherwise(y)


def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    scaled = vectors.withColumn("embedding", F.transform("embedding", lambda x: _scaled(x)))
    found = topk.top_k(scaled, F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_digests(mixing.mix_sources(table(spark, folder, "documents"), WEIGHTS))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(table(spark, folder, "documents")))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    return quality.score_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), model).select("doc_id", "score", "keep")


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    codec = vocabulary(spark)
    return bpe.token_digests(bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), codec, decoded="decoded"), codec)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_digests(table(spark, folder, "documents"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_digests(pii.find_personal_data(table(spark, folder, "documents")))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_digests(jaccard.near_texts(table(spark, folder, "documents")))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
e AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM s)),
n AS (SELECT doc_id, len(s) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id FROM n JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) m ON m.node = n.doc_id
"""


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_groups(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return bisector.cluster_vectors(table(spark, folder, "embeddings"))


def _nearest_sql(centroids: str) -> str:
    return f"SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, k.c, CAST(list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {centroids} k) GROUP BY vec_id"


def _moved_sql(assigned: str, centroids: str) -> str:
    return (f"SELECT k.c, coalesce(m.e, k.e) AS e FROM {centroids} k LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM ("
            f"SELECT a.c, i, sum(v.e[i]) AS s, count(*) AS n FROM {assigned} a JOIN v USING (vec_id), range(1, 65) r(i) GROUP BY a.c, i) GROUP BY c) m USING (c)")


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h LIMIT 16)),
a0 AS MATERIALIZED ({_nearest_sql('c0')}), c1 AS MATERIALIZED ({_moved_sql('a0', 'c0')}),
a1 AS MATERIALIZED ({_nearest_sql('c1')}), c2 AS MATERIALIZED ({_moved_sql('a1', 'c1')}),
a2 AS MATERIALIZED ({_nearest_sql('c2')}), c3 AS MATERIALIZED ({_moved_sql('a2', 'c2')}),
a3 AS MATERIALIZED ({_nearest_sql('c3')})
SELECT a3.vec_id, CAST(a3.c AS INTEGER) AS cluster, a3.d AS distance, CAST(sum(a3.d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(a3.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.e, ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (c)
"""


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, folder, "documents"))


def _field_sql(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"


_LEAF_SQL = " || ".join(_field_sql(x) for x in ("doc_id", "source", "lang", "n_chars"))


def _tree_sql(name: str, nodes: str) -> str:
    """Nodes of all levels (g, lvl, pos, n, d) by recursion, and per run of three its digests in order."""
    return f"""{name} AS (SELECT g, 0 AS lvl, pos, n, d FROM {nodes} UNION ALL
  SELECT g, any_value(lvl + 1), any_value(pos // 3), any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, pos // 3),
{name}_runs AS (SELECT g, lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 3)"""


def _walk_sql(name: str, tree: str, start: str) -> str:
    """From every start (id, g, pos, n, found, proof) up to the root: the digest that siblings give, and the siblings."""
    left, right = "array_to_string(ds[1:pos % 3], '')", "array_to_string(ds[pos % 3 + 2:], '')"
    return f"""{name} AS (SELECT id, g, 0 AS lvl, pos, n, found, proof FROM {start} UNION ALL
  SELECT id, w.g, w.lvl + 1, pos // 3, (n + 2) // 3, sha256({left} || found || {right}), proof || {left} || {right}
  FROM {name} w JOIN {tree}_runs k ON k.g = w.g AND k.lvl = w.lvl AND k.run = w.pos // 3 WHERE n > 1)"""


OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS done, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) UNION ALL
  SELECT doc_id, s, done + 1, list_reduce(list_prepend(xor(c, CAST(ascii(s[done + 1]) AS BIGINT)), [CAST(x AS BIGINT) for x in range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
  FROM crc WHERE done < length(s)),
leaves AS (
  SELECT d.doc_id, coalesce('1' || d.source, '0') AS g, sha256({_LEAF_SQL} || {_field_sql('text')}) AS d,
    sha256({_LEAF_SQL} || {_field_sql("(CASE WHEN xor(k.c, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")}) AS found
  FROM documents d LEFT JOIN (SELECT doc_id AS key, c FROM crc WHERE done = length(s)) k ON k.key = d.doc_id),
placed AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, '' AS proof FROM leaves),
{_tree_sql('tree', 'placed')},
subroots AS (SELECT g AS source, d FROM tree WHERE n = 1),
tops AS (SELECT 0 AS g, source, d, row_number() OVER (ORDER BY source) - 1 AS pos, count(*) OVER () AS n FROM subroots),
{_tree_sql('upper_tree', 'tops')},
{_walk_sql('walk', 'tree', 'placed')},
risen AS (SELECT w.id, t.g, t.pos, t.n, w.found, w.proof FROM walk w JOIN tops t ON t.source = w.g WHERE w.n = 1),
{_walk_sql('upper_walk', 'upper_tree', 'risen')}
SELECT p.doc_id, p.d AS leaf, s.d AS subroot, r.d AS root, sha256(u.proof) AS proof_sha256, u.found AS folded_root, u.found = r.d AS verified
FROM placed p JOIN upper_walk u ON u.id = p.id AND u.n = 1 JOIN subroots s ON s.source = p.g, (SELECT d FROM upper_tree WHERE n = 1) r
"""


def op13_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_texts(table(spark, folder, "pages"))


OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(url, '//([^/?#]*)', 1) AS host, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS x,
  [regexp_extract(html, '<nav>.*?</nav>', 0, 's'), regexp_extract(html, '<div class="ad">.*?</div>', 0, 's'), regexp_extract(html, '<footer>.*?</footer>', 0, 's')] AS parts FROM pages),
b AS (SELECT page_id, url, host, parts, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda y: regexp_replace(regexp_replace(y, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS blocks FROM a),
c AS (SELECT page_id, url, host, parts, list_transform(blocks, lambda y: regexp_replace(regexp_replace(regexp_replace(regexp_replace(y, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS blocks FROM b),
t AS (SELECT page_id, url, host, parts, list_filter(list_transform(blocks, lambda y: trim(regexp_replace(y, '\s+', ' ', 'g'))), lambda y: y <> '') AS blocks FROM c),
m AS (SELECT *, list_reduce(list_prepend('', blocks), lambda u, v: CASE WHEN length(v) > length(u) THEN v ELSE u END) AS mark FROM t),
n AS (SELECT host, count(DISTINCT mark) AS n FROM m GROUP BY host),
k AS (SELECT host, part FROM (SELECT host, mark, unnest(parts) AS part FROM m) JOIN n USING (host) GROUP BY host, part, n HAVING count(DISTINCT mark) >= greatest(3, 0.001 * n)),
f AS (SELECT page_id, count(k.part) AS found FROM (SELECT page_id, host, unnest(parts) AS part FROM m) p LEFT JOIN k ON k.host = p.host AND k.part = p.part GROUP BY page_id)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars, found AS n_templates FROM m JOIN f USING (page_id)
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_exact_top_k, op3_mix_sources, op4_secret_scan, op5_quality, op6_byte_bpe, op7_line_dedup, op8_personal_data, op9_jaccard_join, op10_near_vectors, op11_centroid_clusters, op12_merkle_manifest, op13_page_texts, pipeline)}
SQL = {"op2_exact_top_k": OP2_SQL, "op9_jaccard_join": OP9_SQL, "op11_centroid_clusters": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_page_texts": OP13_SQL}
