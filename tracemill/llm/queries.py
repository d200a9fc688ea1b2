"""The registered queries of this package: every operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.llm import (
    ans_files,
    chunk_bpe,
    exact_topk,
    host_reputation,
    html_trees,
    lookup_clusters,
    packing,
    repeated_spans,
    rotation_codes,
    simhash_tiles,
    source_schedule,
    spelling_bits,
    toxicity,
)
from tracemill.llm.common import table
from tracemill.llm.host_reputation import Rule
from tracemill.llm.tokens import vocabulary_path

QUERIES, ORACLES = {}, {}

RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


ORACLES["op1_rotation_codes"] = """
WITH RECURSIVE fit AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM fit UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
smallest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(s.b, e.vec_id) AS component_id,
       coalesce(e.vec_id = coalesce(s.b, e.vec_id), true) AS kept
FROM embeddings e LEFT JOIN smallest s ON s.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

ORACLES["op3_host_reputation"] = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
),
cut AS (SELECT page_id, r, coalesce(regexp_extract(r, '^[^/?#]*'), '') AS h FROM rest),
parts AS (
    SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(substr(r, length(h) + 1), '^[^?#]*'), '') AS path
    FROM cut
),
known AS (
    SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
),
hosts AS (
    SELECT host, count(k.bad) AS n, coalesce(sum(k.bad), 0) AS bad,
           regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare
    FROM parts LEFT JOIN known k USING (page_id) GROUP BY host
),
named AS (
    SELECT *, list_aggregate(list_slice(string_split(bare, '.'), -2, NULL), 'string_agg', '.') AS domain,
           string_split(bare, '.')[-1] AS suffix FROM hosts
),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM suffixes),
sw AS (
    SELECT any_value(m) AS m, 1 / least(greatest(coalesce(CASE WHEN sum(n) > count(*) FILTER (n > 0)
        THEN (sum(CASE WHEN n > 0 THEN n * (bad / n - m) ** 2 END) / (any_value(m) * (1 - any_value(m))) - count(*) FILTER (n > 0))
             / (sum(n) - count(*) FILTER (n > 0)) ELSE 0 END, 0), 1 / 1001), 0.5) - 1 AS w
    FROM suffixes, top
),
sp AS (SELECT suffix, (bad + w * m) / (n + w) AS m FROM suffixes, sw),
dw AS (
    SELECT suffix, any_value(m) AS m, 1 / least(greatest(coalesce(CASE WHEN sum(n) > count(*) FILTER (n > 0)
        THEN (sum(CASE WHEN n > 0 THEN n * (bad / n - m) ** 2 END) / (any_value(m) * (1 - any_value(m))) - count(*) FILTER (n > 0))
             / (sum(n) - count(*) FILTER (n > 0)) ELSE 0 END, 0), 1 / 1001), 0.5) - 1 AS w
    FROM domains JOIN sp USING (suffix) GROUP BY suffix
),
dp AS (SELECT domain, (bad + w * m) / (n + w) AS m FROM domains JOIN dw USING (suffix)),
hw AS (
    SELECT domain, any_value(m) AS m, 1 / least(greatest(coalesce(CASE WHEN sum(n) > count(*) FILTER (n > 0)
        THEN (sum(CASE WHEN n > 0 THEN n * (bad / n - m) ** 2 END) / (any_value(m) * (1 - any_value(m))) - count(*) FILTER (n > 0))
             / (sum(n) - count(*) FILTER (n > 0)) ELSE 0 END, 0), 1 / 1001), 0.5) - 1 AS w
    FROM named JOIN dp USING (domain) GROUP BY domain
),
hp AS (SELECT host, (bad + w * m) / (n + w) AS mean, n + w AS whole FROM named JOIN hw USING (domain)),
judged AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (whole + 1)) > 0.5 AS blocked FROM hp),
ruled AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN judged USING (host)
"""

ORACLES["op6_exact_topk"] = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""


_ASSIGN = """
near{r} AS (
    SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS b
    FROM (SELECT k.rid, k.vec_id, k.v, c.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) ** 2)) AS d
          FROM kept k CROSS JOIN centre{r} c) GROUP BY rid
),"""
_MOVE = """
moved{r} AS (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT b.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM near{r}, range(1, 65) p(i) GROUP BY ALL) GROUP BY c
),
centre{s} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM centre{r} o LEFT JOIN moved{r} m ON o.c = m.c),"""

ORACLES["op11_lookup_clusters"] = (
    """
WITH kept AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(64 * CAST(x AS DOUBLE)) < 134217728)) = 64
),
centre0 AS (
    SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v
    FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 16
),"""
    + "".join(_ASSIGN.format(r=r) + _MOVE.format(r=r, s=r + 1) for r in range(3))
    + _ASSIGN.format(r=3)
    + """
found AS (SELECT vec_id, b.c AS cluster, CAST(b.d AS BIGINT) AS distance FROM near3)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM found JOIN centre3 ON c = cluster
"""
)

ORACLES["op12_source_schedule"] = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS BIGINT) AS size FROM documents
),
copies AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS copy FROM sized),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
    FROM sized GROUP BY source
),
ordered AS (
    SELECT *, coalesce(sum(3 * s) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS weights, sum(s) OVER () AS whole, sum(w) OVER () AS weight
    FROM sources
    WINDOW o AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
capped AS (SELECT *, 3 * s * (weight - weights) <= (whole - caps) * w AS at_cap FROM ordered),
targets AS (
    SELECT source, s, CASE WHEN at_cap THEN CAST(3 * s AS DOUBLE) ELSE
        CAST((whole - coalesce(sum(CASE WHEN at_cap THEN 3 * s END) OVER (), 0)) * w AS DOUBLE)
        / CAST(weight - coalesce(sum(CASE WHEN at_cap THEN w END) OVER (), 0) AS DOUBLE) END AS target
    FROM capped
),
placed AS (
    SELECT c.*, t.s, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
           CAST(sum(size) OVER (PARTITION BY c.source ORDER BY
               md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), CAST(size AS VARCHAR), CAST(copy AS VARCHAR)))
               ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
    FROM copies c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, s AS source_size, target, source, copy, CASE WHEN s = 0 THEN 0 ELSE
    words // s * size + greatest(least(upto, words % s) - (upto - size), 0) END AS taken
FROM placed
"""


@query
def op1_rotation_codes(spark, sf_dir):
    return rotation_codes.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_run_index(spark, sf_dir):
    left = repeated_spans.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return left.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("_kept")).alias("n_removed"),
        F.size("_runs").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


@query
def op3_host_reputation(spark, sf_dir):
    # a labelled page is bad if it is of low quality or toxic
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 OR toxic = 1").alias("bad"))
    return host_reputation.judged(table(spark, sf_dir, "pages"), labels, RULES)


def held_out(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


@query
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.scored(docs, weights).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op5_html_trees(spark, sf_dir):
    found = html_trees.extracted(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op6_exact_topk(spark, sf_dir):
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


@query
def op8_chunk_bpe(spark, sf_dir):
    made = chunk_bpe.encoded(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_ans_files(spark, sf_dir):
    path = ans_files.new_path(spark)
    ans_files.write(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), 49_408, 2, path)
    return ans_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_simhash_tiles(spark, sf_dir):
    return simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_lookup_clusters(spark, sf_dir):
    return lookup_clusters.clusters_with_inertia(table(spark, sf_dir, "embeddings"))


@query
def op12_source_schedule(spark, sf_dir):
    return source_schedule.taken(table(spark, sf_dir, "documents"))


@query
def op13_spelling_bits(spark, sf_dir):
    return spelling_bits.variants(table(spark, sf_dir, "documents"))
