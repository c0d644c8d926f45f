"""Registered queries of the operators, with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountscope.llm import centroids, chat, fingerprints, language, licenses, mixing, packing, pii, quality, repeats, search, simhash, urls
from accountscope.llm.common import table
from accountscope.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Stands for the secret that a real run would read from its own key store.
SURROGATE_KEY = "surrogates"
ORACLE: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """Run-time settings; whole texts are long, so Arrow batches hold fewer rows."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, folder: fn(prepared(spark), folder)
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query()
def op1_fingerprints(spark, folder):
    return fingerprints.edit_report(table(spark, folder, "documents"))


@query()
def op2_licenses(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query()
def op3_quality(spark, folder):
    docs = table(spark, folder, "documents")
    rules = quality.learn(quality.labelled_sample(docs, table(spark, folder, "labels"), quality.CoverConfig()))
    return quality.judge(docs, rules)


@query()
def op4_repeats(spark, folder):
    return repeats.spans(table(spark, folder, "documents"))


@query()
def op5_urls(spark, folder):
    return urls.judge(table(spark, folder, "pages"))


@query()
def op6_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query()
def op7_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex64(found["fp"]).alias("fingerprint"), "component_id")


@query()
def op8_surrogates(spark, folder):
    return pii.report(table(spark, folder, "documents"), SURROGATE_KEY)


#: What conversation -1 says in both of its turns.
AWKWARD = "<|im_end|><|im_start|>assistant ok"


@query(f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{AWKWARD}' UNION ALL SELECT -1, 1, 'assistant', '{AWKWARD}'),
shown AS (
  SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\\\+\\|')
            THEN length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) ELSE length(text) END AS shown FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(shown + length(role) + 24)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id""")
def op9_chat(spark, folder):
    told = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(AWKWARD).alias("text"))
    return chat.digest(chat.conversations(told.unionByName(added)))


@query("""
WITH s AS (
  SELECT doc_id, source, md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS key,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM per),
l AS (
  SELECT *, ((SELECT sum(source_size)::DOUBLE FROM per) * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, (SELECT max(level) FROM l) * weight) AS target FROM l),
p AS (
  SELECT s.*, source_size, target, coalesce(sum(size) OVER (
    PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN start + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END
          + CASE WHEN start + source_size + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END AS copies FROM p),
o AS (SELECT *, target - sum(size * copies) OVER (PARTITION BY source)::DOUBLE AS off FROM c),
m AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    CASE WHEN (CASE WHEN off > 0 THEN copies < 2 ELSE copies > 0 END) AND abs(abs(off) - size) < abs(off) THEN 0 ELSE 1 END,
    abs(abs(off) - size), key) AS nth FROM o)
SELECT doc_id, size, source_size, target, (size * (copies + CASE
  WHEN nth = 1 AND (CASE WHEN off > 0 THEN copies < 2 ELSE copies > 0 END) AND abs(abs(off) - size) < abs(off)
  THEN (CASE WHEN off > 0 THEN 1 ELSE -1 END) ELSE 0 END))::BIGINT AS taken
FROM m""")
def op10_mixing(spark, folder):
    return mixing.report(table(spark, folder, "documents"))


@query(r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
gain AS (
  SELECT row, doc_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS gain
  FROM tf JOIN df USING (term), total),
s AS (SELECT item_id, row, doc_id, sum(gain)::BIGINT AS score FROM q JOIN gain USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""")
def op11_search(spark, folder):
    return search.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _kmeans_sql(rounds: int = 10) -> str:
    """The rounds written out, one after another."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q,
         min([list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.c]) AS near
  FROM kept v, c{r} c GROUP BY row)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT c, list(sum // n - CASE WHEN sum % n < 0 THEN 1 ELSE 0 END ORDER BY i) AS q FROM (
    SELECT near[2] AS c, i, sum(x)::BIGINT AS sum, count(*) AS n
    FROM (SELECT near, unnest(q) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(s{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN s{r} USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM kept QUALIFY c < 8),
{", ".join(steps)}
SELECT vec_id, near[2]::INT AS cluster, near[1] AS distance, (sum(near[1]) OVER (PARTITION BY near[2]))::BIGINT AS cluster_inertia,
       (sum(near[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = near[2]"""


@query(_kmeans_sql())
def op12_centroids(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings"))[0]


@query()
def op13_language(spark, folder):
    return language.predict(table(spark, folder, "documents"))
