"""Registered search queries. The question vectors are the mean vectors of the labels: a batch of
fixed size, computed from the whole table and searched over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import quantised, search
from corpusloom.operators.hits import top_hits
from corpusloom.plans.tables import table

K = C.DEFAULT_SEARCH_K
FILTER = {"$and": [{"label": {"$in": [1, 3, 5, 7]}}, {"kind": "vector"}]}


def _collection(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _questions(collection):
    return search.label_means(collection).withColumnRenamed("label", "query_id")


def _shown(hits):
    return hits.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def _knn(spark, sf_dir, metric="l2", k=K, where=None):
    rows = _collection(spark, sf_dir)
    return _shown(search.nearest(rows, _questions(rows), k, metric, where, id_col="vec_id"))


def knn_l2_topk(spark, sf_dir):
    return _knn(spark, sf_dir)


def knn_cosine_topk(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


def knn_inner_topk(spark, sf_dir):
    return _knn(spark, sf_dir, "ip")


def knn_filtered_topk(spark, sf_dir):
    """Membership and equality together, below the search; k is enlarged by the overlap."""
    rows = _collection(spark, sf_dir).withColumn("kind", F.lit("vector"))
    k = min(K + C.DEFAULT_K_OVERLAP, C.MAX_SEARCH_K)
    return _shown(search.nearest(rows, _questions(rows), k, "l2", FILTER, id_col="vec_id"))


def knn_max_k(spark, sf_dir):
    """A larger k than allowed is cut to the maximum."""
    return _knn(spark, sf_dir, k=C.MAX_SEARCH_K + 50)


def knn_cells_exact(spark, sf_dir):
    """Search over the cell index, with the cells that cannot hold a nearer row left out."""
    rows = _collection(spark, sf_dir)
    centres, indexed = search.build_cells(rows, 16)
    hits = search.nearest_in_cells(indexed, centres, _questions(rows), K, 4, True, id_col="vec_id")
    return _shown(hits)


def knn_cells_approx(spark, sf_dir):
    """Three cells for each question, around the label means."""
    rows = _collection(spark, sf_dir)
    means = [r.query_vector for r in _questions(rows).orderBy("query_id").collect()]  # one a label
    centres, indexed = search.build_cells(rows, centres=means)
    return _shown(search.nearest_in_cells(indexed, centres, _questions(rows), K, 3, id_col="vec_id"))


def _quantised(spark, sf_dir):
    """(hits by codes, hits by measuring every row), ten each, for every twentieth vector."""
    rows = _collection(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    book = quantised.fit(rows, 16, id_col="vec_id")
    hits = quantised.search(quantised.build(rows, book, id_col="vec_id"), book, asked, 10, id_col="vec_id")
    return hits, search.nearest(rows, asked, 10, id_col="vec_id")


def knn_quantised(spark, sf_dir):
    """Search by codes of sixteen bytes, candidates measured exactly."""
    return _shown(_quantised(spark, sf_dir)[0])


def knn_quantised_recall(spark, sf_dir):
    """Whether such a search finds nine tenths of what measuring every row finds, and how many of
    its scores are not those of the rows."""
    hits, full = _quantised(spark, sf_dir)
    full = full.select("query_id", "vec_id", F.col("score").alias("_score"))
    both = hits.join(full, ["query_id", "vec_id"], "left")
    return both.agg(
        F.count("*").alias("hits"), (F.count("_score") >= 0.9 * F.count("*")).alias("recalled"),
        F.count_if(F.col("score") != F.col("_score")).alias("odd_scores"),
    )


def knn_every_vector(spark, sf_dir):
    """Every vector as a question."""
    rows = _collection(spark, sf_dir)
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _shown(search.nearest(rows, asked, 3, id_col="vec_id"))


def _with_gaps(rows):
    """Every seventh vector has a component that is no number."""
    broken = F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))
    return rows.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, broken).otherwise(F.col("embedding")))


def knn_finite_topk(spark, sf_dir):
    rows = _collection(spark, sf_dir)
    return _shown(search.nearest(_with_gaps(rows), _questions(rows), K, id_col="vec_id"))


def unsearchable_vectors(spark, sf_dir):
    return search.unsearchable(_with_gaps(_collection(spark, sf_dir)))


def hits_with_labels(spark, sf_dir):
    """First three hits of every question with the columns of the collection put on them."""
    rows = _collection(spark, sf_dir)
    hits = top_hits(search.nearest(rows, _questions(rows), K, id_col="vec_id"), C.CONTEXT_HITS)
    out = search.with_content(hits, rows.select("vec_id", "label"), "vec_id")
    return out.select("query_id", "rank", "vec_id", "label", F.round("score", 9).alias("score"))


QUERIES = {f.__name__: f for f in (
    knn_l2_topk, knn_cosine_topk, knn_inner_topk, knn_filtered_topk, knn_max_k,
    knn_cells_exact, knn_cells_approx, knn_quantised, knn_quantised_recall, knn_every_vector, knn_finite_topk, unsearchable_vectors, hits_with_labels,
)}

_DISTANCE = {
    "l2": "pow(list_distance(v, q), 2)",
    "cosine": "1 - list_cosine_similarity(v, q)",
    "ip": "1 - list_inner_product(v, q)",
}


def _sql(metric: str, k: int, where: str = "true") -> str:
    return f"""WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
means AS (SELECT query_id, list(a ORDER BY i) AS q FROM (
  SELECT label AS query_id, i, avg(x) AS a
  FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i)
  GROUP BY query_id),
found AS (SELECT query_id, vec_id, label, round({_DISTANCE[metric]}, 9) AS d FROM means, e WHERE {where}),
hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank,
  vec_id, label, round(1 - d, 9) AS score FROM found)
SELECT query_id, rank, vec_id, score FROM hits WHERE rank <= {k}"""


ORACLE = {
    "knn_l2_topk": _sql("l2", K),
    "knn_cosine_topk": _sql("cosine", K),
    "knn_inner_topk": _sql("ip", K),
    "knn_filtered_topk": _sql("l2", K + C.DEFAULT_K_OVERLAP, "label IN (1, 3, 5, 7)"),
    "knn_max_k": _sql("l2", C.MAX_SEARCH_K),
    "knn_cells_exact": _sql("l2", K),
    "knn_finite_topk": _sql("l2", K, "vec_id % 7 <> 0"),
    "unsearchable_vectors": "SELECT count(*) AS rows, count(*) FILTER (vec_id % 7 = 0) AS unsearchable FROM embeddings",
    "knn_every_vector": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
found AS (SELECT a.vec_id AS query_id, b.vec_id, round(pow(list_distance(a.v, b.v), 2), 9) AS d FROM e a, e b),
hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank, vec_id, round(1 - d, 9) AS score FROM found)
SELECT * FROM hits WHERE rank <= 3""",
    "knn_cells_approx": _sql("l2", K).replace("found AS (", """celled AS (SELECT vec_id, label, v,
  (SELECT arg_min(query_id, list_distance(e.v, q)) FROM means) AS cell FROM e),
probed AS (SELECT query_id, cell FROM (SELECT a.query_id, b.query_id AS cell,
  row_number() OVER (PARTITION BY a.query_id ORDER BY list_distance(a.q, b.q)) AS n FROM means a, means b) WHERE n <= 3),
found AS (""").replace("FROM means, e WHERE true", "FROM means JOIN probed USING (query_id) JOIN celled USING (cell)"),
    "knn_quantised_recall": "SELECT (count(*) FILTER (vec_id % 20 = 0) * least(count(*), 10))::BIGINT AS hits, true AS recalled, 0::BIGINT AS odd_scores FROM embeddings",
    "hits_with_labels": _sql("l2", C.CONTEXT_HITS).replace(
        "SELECT query_id, rank, vec_id, score FROM", "SELECT query_id, rank, vec_id, label, score FROM"
    ),
}
