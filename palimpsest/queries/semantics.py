"""Vector search. The index is `embeddings` with the text of the document of the same number; labels are index ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import nearby, semantic
from palimpsest.queries.common import Registry, n3, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
QUERY = "que da reaux"
#: The vector of this number is the query.
VECTOR = 7
_DOT = "list_dot_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"
_TEXT = n3("replace(text, '*', '')")
_META = n3("coalesce(lang, '') || ' ' || coalesce(source, '')")
INDEX = f"idx AS (SELECT e.label::VARCHAR AS index_id, e.vec_id AS pos, e.vec_id AS row, d.text, d.lang, d.source, {_DOT} AS semantic FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"


#: The query's terms without stop words are these two.
_COV = "len(list_intersect(string_split({x}, ' '), ['que', 'reaux'])) / 2.0::DOUBLE"
ALIGNED = f"""normal AS (SELECT *, {_TEXT} AS t, {_META} AS m FROM idx),
first AS (SELECT *, instr(t, 'que') AS p1 FROM normal),
second AS (SELECT *, instr(substr(t, CASE WHEN p1 > 0 THEN p1 + 3 ELSE 1 END), 'reaux') AS p2 FROM first),
aligned AS (SELECT *, least(1.0::DOUBLE, 0.44::DOUBLE * ({_COV.format(x='t')}) + 0.18::DOUBLE * (((p1 > 0)::INT + (p2 > 0)::INT) / 2.0::DOUBLE) + 0.24::DOUBLE * (contains(t, 'que da reaux')::INT)::DOUBLE + 0.10::DOUBLE * ({_COV.format(x='m')}) + 0.04::DOUBLE * (contains(m, 'que da reaux')::INT)::DOUBLE) AS alignment FROM second)"""


def _index(spark, sf_dir):
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    joined = e.join(d, e["vec_id"] == d["doc_id"])
    return joined.select(F.col("label").cast("string").alias("index_id"), F.col("vec_id").alias("pos"), F.col("vec_id").alias("row"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"), "embedding")


def _vector(spark, sf_dir):
    """The query's vector: one row, read on the driver like any query."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == VECTOR).select("embedding").first()
    return semantic.vector(row.embedding)


@R.add(f"WITH {INDEX} SELECT index_id, row, semantic, row_number() OVER (PARTITION BY index_id ORDER BY semantic DESC, row) AS place FROM idx QUALIFY place <= 5")
def sem_topk(spark, sf_dir):
    from pyspark.sql import Window

    s = semantic.eligible(_index(spark, sf_dir), _vector(spark, sf_dir), minimum=0.0)
    s = s.where("threshold <= 0 or semantic >= threshold")
    order = Window.partitionBy("index_id").orderBy(F.desc("semantic"), "row", "pos")
    return s.withColumn("place", F.row_number().over(order)).where("place <= 5").select("index_id", "row", "semantic", "place")


@R.add(f"WITH {INDEX} SELECT index_id, count(*) AS total, 0::BIGINT AS filtered FROM idx WHERE semantic >= 0.25 GROUP BY index_id")
def sem_threshold_counts(spark, sf_dir):
    return semantic.counts(semantic.eligible(_index(spark, sf_dir), _vector(spark, sf_dir)))


@R.add(f"WITH {INDEX}, normal AS (SELECT *, {_TEXT} AS t FROM idx WHERE semantic >= 0.1), lex AS (SELECT *, contains(t, 'que') AND contains(t, 'eaux') AS lexical FROM normal) SELECT index_id, count(*) FILTER (NOT lexical) AS total, count(*) FILTER (lexical) AS filtered FROM lex GROUP BY index_id")
def sem_antifilter_counts(spark, sf_dir):
    return semantic.counts(semantic.eligible(_index(spark, sf_dir), _vector(spark, sf_dir), "que eaux", 0.1, exclude=True))


@R.add(f"WITH {INDEX}, {ALIGNED} SELECT row, alignment FROM aligned")
def sem_alignment(spark, sf_dir):
    i = _index(spark, sf_dir)
    return semantic.normalised(i, F.col("text"), F.col("metadata")).select("row", semantic.alignment(QUERY, F.col("_text"), F.col("_meta")).alias("alignment"))


_POOL = f"""{INDEX}, {ALIGNED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY semantic DESC, row) AS nth, count(*) OVER (PARTITION BY index_id) AS total FROM aligned),
pool AS (SELECT *, least(1.0::DOUBLE, 0.82::DOUBLE * semantic + 0.18::DOUBLE * alignment) AS score FROM ranked WHERE nth <= least(total, greatest(least({{k}}, total), least(40, 4 * least({{k}}, total))))),
best AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY score DESC, semantic DESC, row) AS rank FROM pool QUALIFY rank <= {{k}})"""


@R.add(f"WITH {_POOL.replace("{k}", "5")} SELECT index_id, row, score, alignment, rank FROM best")
def sem_rerank(spark, sf_dir):
    return semantic.search(_index(spark, sf_dir), _vector(spark, sf_dir), QUERY, 5, 0.0).select("index_id", "row", "score", "alignment", "rank")


@R.add(f"WITH {_POOL.replace("{k}", "12")} SELECT index_id, row, score, row_number() OVER (ORDER BY score DESC, lower(index_id), rank) AS place FROM best QUALIFY place <= 12")
def sem_overview_rows(spark, sf_dir):
    return semantic.overview(_index(spark, sf_dir), _vector(spark, sf_dir), QUERY, 12, 0.0).select("index_id", "row", "score", "place")


@R.add(f"WITH {_POOL.replace("{k}", "12")}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, lower(index_id), rank) AS place FROM best QUALIFY place <= 12) SELECT index_id, max(total) AS total, count(*) AS shown, max(score) AS top_score FROM top GROUP BY index_id")
def sem_overview_totals(spark, sf_dir):
    o = semantic.overview(_index(spark, sf_dir), _vector(spark, sf_dir), QUERY, 12, 0.0)
    return o.groupBy("index_id").agg(F.max("total").alias("total"), F.count("*").alias("shown"), F.max("score").alias("top_score"))


#: Recommended thresholds of indexes; every third one has none.
_LIMITS = "limits AS (SELECT DISTINCT label::VARCHAR AS index_id, CASE WHEN label % 3 = 0 THEN NULL ELSE (label % 3) / 10.0::DOUBLE END AS recommended FROM embeddings)"


def _limits(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return labels.select(F.col("label").cast("string").alias("index_id"), F.when(F.col("label") % 3 != 0, (F.col("label") % 3) / 10.0).alias("recommended"))


@R.add(f"WITH {INDEX}, {_LIMITS} SELECT index_id, count(*) AS total FROM idx JOIN limits USING (index_id) WHERE semantic >= coalesce(recommended, 0.25) GROUP BY index_id")
def sem_own_thresholds(spark, sf_dir):
    """Each index by its own recommended threshold."""
    return semantic.counts(semantic.eligible(_index(spark, sf_dir), _vector(spark, sf_dir), thresholds=_limits(spark, sf_dir))).select("index_id", "total")


@R.add(f"WITH {_POOL.replace("{k}", "12")}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, lower(index_id), rank) AS overall FROM best QUALIFY overall <= 12) SELECT index_id, 'L' || index_id AS label, max(total) AS total, count(*) AS shown_count, max(score) AS top_score, row_number() OVER (ORDER BY max(score) DESC, min(overall)) AS place FROM top GROUP BY index_id")
def sem_overview_groups(spark, sf_dir):
    """Indexes by their best row."""
    shown = semantic.overview(_index(spark, sf_dir), _vector(spark, sf_dir), QUERY, 12, 0.0)
    labels = _limits(spark, sf_dir).select("index_id", F.concat(F.lit("L"), "index_id").alias("label"))
    return semantic.overview_groups(shown, labels).drop("matches")


@R.add(f"WITH {INDEX}, {_LIMITS}, normal AS (SELECT *, {_TEXT} AS t FROM idx JOIN limits USING (index_id) WHERE semantic >= coalesce(recommended, 0.25)), s AS (SELECT count(*) FILTER (NOT (contains(t, 'que') AND contains(t, 'eaux'))) AS total, count(*) FILTER (contains(t, 'que') AND contains(t, 'eaux')) AS filtered FROM normal) SELECT (SELECT count(*) FROM limits) AS indexes, (SELECT min(coalesce(recommended, 0.25::DOUBLE)) FROM limits) AS lowest_recommended, (SELECT max(coalesce(recommended, 0.25::DOUBLE)) FROM limits) AS highest_recommended, total, filtered FROM s")
def sem_overview_all(spark, sf_dir):
    """Totals over all indexes, shown or not."""
    limits = _limits(spark, sf_dir)
    return semantic.overview_totals(semantic.eligible(_index(spark, sf_dir), _vector(spark, sf_dir), "que eaux", exclude=True, thresholds=limits), limits, limits)


_MANY = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(embedding::DOUBLE[], q) AS similarity FROM embeddings, q)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s QUALIFY place <= 3"""


@R.add(_MANY)
def sem_multi_query(spark, sf_dir):
    """A stated set of queries against all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return semantic.nearest(e, asked, 3).select("query_id", F.col("id").alias("vec_id"), "place")


@R.add(_MANY)
def sem_pivots(spark, sf_dir):
    """The same by rings around pivots, of which those are met that can hold an answer."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found, _ = nearby.nearest(e, e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 3, block=256)
    return found.select("query_id", F.col("id").alias("vec_id"), "place")


@R.add("SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size, (embedding[1]::DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS first FROM embeddings")
def vec_l2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.sqrt(semantic.dot(F.col("embedding"), F.col("embedding"))).alias("size"), semantic.unit(F.col("embedding"))[0].alias("first"))


@R.add("""WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS nth, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size, CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.84 ELSE 0.72 END AS weight FROM embeddings),
m AS (SELECT nth, sum(x / size * weight) / sum(weight) AS x FROM p GROUP BY nth)
SELECT nth - 1 AS nth, round(x / (SELECT sqrt(sum(x * x)) FROM m), 6) AS x FROM m""")
def sem_weighted_query(spark, sf_dir):
    n = F.col("vec_id") % 3
    q = table(spark, sf_dir, "embeddings").select("embedding", F.when(n == 0, 1.0).when(n == 1, 0.84).otherwise(0.72).alias("weight"))
    return semantic.weighted_query(q).select(F.posexplode("embedding").alias("nth", "x")).select("nth", F.round("x", 6).alias("x"))


_DRAW = "(('0x' || substr(md5('0|{}|' || index_id || '|' || k), 1, 15))::BIGINT % {})"


@R.add(f"""WITH v AS (SELECT label::VARCHAR AS index_id, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
sizes AS (SELECT index_id, count(*) AS n FROM v GROUP BY index_id HAVING count(*) > 1),
draws AS (SELECT index_id, n, unnest(range(1, least(greatest(500, 2 * n), 5000) + 1)) AS k FROM sizes),
ends AS (SELECT index_id, {_DRAW.format(0, 'n')} AS l, ({_DRAW.format(0, 'n')} + 1 + {_DRAW.format(1, '(n - 1)')}) % n AS r FROM draws),
s AS (SELECT e.index_id, list_dot_product(a.x, b.x) AS similarity FROM ends e JOIN v a ON a.index_id = e.index_id AND a.pos = e.l JOIN v b ON b.index_id = e.index_id AND b.pos = e.r)
SELECT index_id, count(*) AS pairs, round(avg(similarity), 9) AS mean, quantile_cont(similarity, 0.95) AS p95, quantile_cont(similarity, 0.99) AS p99, quantile_cont(similarity, 0.999) AS p999, max(similarity) AS highest, greatest(0.25, least(1.0, ceil((quantile_cont(similarity, 0.99) + 0.02) * 100) / 100)) AS recommended FROM s GROUP BY index_id""")
def sem_calibration(spark, sf_dir):
    """Random pairs of each index, 5000 at most."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    v = e.select(F.col("label").cast("string").alias("index_id"), place.alias("pos"), "embedding")
    return semantic.calibration(semantic.sampled_pairs(v)).withColumn("mean", F.round("mean", 9))


@R.add("SELECT vec_id, greatest(0.25, least(1.0, ceil((abs(embedding[1]::DOUBLE) + 0.02) * 100) / 100)) AS recommended FROM embeddings")
def sem_recommend(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", semantic.recommend(F.abs(F.col("embedding")[0].cast("double"))).alias("recommended"))
