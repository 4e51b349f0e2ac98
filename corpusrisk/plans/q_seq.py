"""Query catalogue, jobs C/E: statement profiling on ``events`` (user = example, events in
``(ts, event_id)`` order = statements) and vector pooling / class statistics on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.functions import vectors as vx
from corpusrisk.operators import evaluate as ev
from corpusrisk.operators import pooling as pl
from corpusrisk.operators import sequences as sq
from corpusrisk.plans.tables import label_text, load

NB_POS_WEIGHT = 3.5


def statements(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "error", F.lit(sq.FREE))
        .when(F.col("event_type") == "purchase", F.lit(sq.ASSIGN))
        .when(F.col("event_type") == "signup", F.lit(sq.MALLOC))
        .otherwise(F.lit(sq.VARDECL))
    )
    s = e.select(F.col("user_id").alias("example"), "event_id", "ts", kind.alias("kind"), F.concat(F.lit("v"), F.pmod(k, F.lit(4)).cast("string")).alias("var"), F.lit(0).alias("depth"))
    return sq.statement_positions(s, "example", ["ts", "event_id"])


SQL_STMTS = """
stmts AS (SELECT user_id AS example, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, 0 AS depth,
                 CASE event_type WHEN 'error' THEN 'Free' WHEN 'purchase' THEN 'Assign' WHEN 'signup' THEN 'Malloc' ELSE 'VarDecl' END AS kind,
                 'v' || CAST(((CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) + 4) % 4 AS VARCHAR) AS var FROM events),
frees AS (SELECT example, var, max(pos) AS free_pos FROM stmts WHERE kind = 'Free' AND depth = 0 GROUP BY example, var),
dist AS (SELECT s.example, min(s.pos - f.free_pos) AS min_uaf_distance FROM stmts s JOIN frees f USING (example, var)
         WHERE s.kind = 'Assign' AND s.depth = 0 AND s.pos > f.free_pos GROUP BY s.example),
prof AS (SELECT t.example, arg_max(t.kind, t.pos) = 'Assign' AS is_last_stmt_assignment, count(*)::BIGINT AS length_in_statements, d.min_uaf_distance
         FROM stmts t LEFT JOIN dist d USING (example) GROUP BY t.example, d.min_uaf_distance)
"""


def q_win_statement_loc(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select("example", "event_id", "pos")


SQL_WIN_STATEMENT_LOC = f"WITH {SQL_STMTS} SELECT example, event_id, pos::BIGINT AS pos FROM stmts"


def q_win_last_free(spark: SparkSession, sf: str) -> DataFrame:
    return sq.last_frees(statements(spark, sf))


SQL_WIN_LAST_FREE = f"WITH {SQL_STMTS} SELECT example, var, free_pos::BIGINT AS free_pos FROM frees"


def q_agg_min_distance(spark: SparkSession, sf: str) -> DataFrame:
    return sq.min_uaf_distance(statements(spark, sf))


SQL_AGG_MIN_DISTANCE = f"WITH {SQL_STMTS} SELECT example, min_uaf_distance::BIGINT AS min_uaf_distance FROM dist"


def q_syn_profile(spark: SparkSession, sf: str) -> DataFrame:
    """``syn_profile`` incl. ``win_last_stmt``: per example distance, last-statement flag, length."""
    return sq.profile(statements(spark, sf))


SQL_SYN_PROFILE = f"WITH {SQL_STMTS} SELECT example, min_uaf_distance::BIGINT AS min_uaf_distance, is_last_stmt_assignment, length_in_statements FROM prof"


def q_agg_uaf_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sq.summary(sq.profile(statements(spark, sf)))


SQL_AGG_UAF_SUMMARY = f"""WITH {SQL_STMTS}
SELECT is_last_stmt_assignment, count(min_uaf_distance)::BIGINT AS distance_count, avg(min_uaf_distance) AS distance_mean, stddev_samp(min_uaf_distance) AS distance_std,
       avg(length_in_statements) AS length_mean, stddev_samp(length_in_statements) AS length_std FROM prof GROUP BY is_last_stmt_assignment"""


def q_agg_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """``agg_last_wins`` (+ ``src_feed`` JSON field parsing): each user's latest event."""
    e = load(spark, sf, "events").withColumn("k", F.from_json("props", "k INT")["k"])
    return sq.latest_per_key(e, "user_id", ["ts", "event_id"], ["event_id", "event_type", "k"])


SQL_AGG_LAST_WINS = """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
       arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), (ts, event_id)) AS k FROM events GROUP BY user_id
"""


# ---------------------------------------------------------------------------------------------- embeddings


def q_agg_pool(spark: SparkSession, sf: str) -> DataFrame:
    """``agg_pool``: embeddings as token vectors of 10 documents (one per label): per document
    and dimension the mean and population sd."""
    return pl.pool_long(load(spark, sf, "embeddings"), "label", "embedding")


SQL_EMB = "emb AS (SELECT vec_id, label, p - 1 AS dim, CAST(x AS DOUBLE) AS x FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, p))"
SQL_AGG_POOL = f"WITH {SQL_EMB} SELECT label, dim::INTEGER AS dim, avg(x) AS mean, stddev_pop(x) AS sd FROM emb GROUP BY label, dim"


def q_fn_concat_vec(spark: SparkSession, sf: str) -> DataFrame:
    """``fn_concat_vec`` / ``ml_pooling_sets`` (mean+sd): pooled vectors side by side."""
    pooled = pl.pool(load(spark, sf, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode(vx.pooled("mean+sd")).alias("i", "value"))


SQL_FN_CONCAT_VEC = f"""WITH {SQL_EMB}, p AS (SELECT label, dim, avg(x) AS mean, stddev_pop(x) AS sd FROM emb GROUP BY label, dim)
SELECT label, dim::INTEGER AS i, mean AS value FROM p UNION ALL SELECT label, (dim + 64)::INTEGER AS i, sd AS value FROM p"""


def q_ml_nb_params(spark: SparkSession, sf: str) -> DataFrame:
    """``ml_nb`` parameters: weighted per-class mean / variance (class 1 = label 0, weight 3.5)."""
    e = load(spark, sf, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    e = e.withColumn("w", ev.sample_weight("y", NB_POS_WEIGHT))
    return pl.gaussian_nb_params(e, "y", "embedding", "w")


SQL_ML_NB_PARAMS = f"""WITH {SQL_EMB},
e AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, CASE WHEN label = 0 THEN {NB_POS_WEIGHT} ELSE 1.0 END::DOUBLE AS w, dim, x FROM emb),
per AS (SELECT y, dim, sum(w) AS sw, sum(w * x) / sum(w) AS theta, greatest(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2, 0) AS var FROM e GROUP BY y, dim),
eps AS (SELECT max(v) * {pl.VAR_SMOOTHING} AS eps FROM (SELECT var_pop(x) AS v FROM e GROUP BY dim)),
tot AS (SELECT sum(w) AS tw FROM e WHERE dim = 0)
SELECT y, dim::INTEGER AS dim, theta, var + eps AS sigma, sw / tw AS prior FROM per, eps, tot"""


def q_jn_index_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``jn_index_vectors`` + ``fn_stack``: labelled index joined to document vectors (inner:
    unmatched rows drop), with the vector width and label number."""
    idx = load(spark, sf, "labels").select(F.col("doc_id").alias("file"), label_text(F.col("quality")).alias("label"))
    vec = load(spark, sf, "embeddings").select(F.col("vec_id").alias("file"), "embedding")
    j = idx.join(vec, "file")
    return j.select("file", ev.label_to_num("label").alias("y"), F.size("embedding").alias("width"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("vsum"))


SQL_JN_INDEX_VECTORS = """
SELECT l.doc_id AS file, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS y, len(e.embedding) AS width, list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) AS vsum
FROM labels l JOIN embeddings e ON l.doc_id = e.vec_id
"""


QUERIES = {
    "win_statement_loc": (q_win_statement_loc, SQL_WIN_STATEMENT_LOC),
    "win_last_free": (q_win_last_free, SQL_WIN_LAST_FREE),
    "agg_min_distance": (q_agg_min_distance, SQL_AGG_MIN_DISTANCE),
    "syn_profile": (q_syn_profile, SQL_SYN_PROFILE),
    "agg_uaf_summary": (q_agg_uaf_summary, SQL_AGG_UAF_SUMMARY),
    "agg_last_wins": (q_agg_last_wins, SQL_AGG_LAST_WINS),
    "agg_pool": (q_agg_pool, SQL_AGG_POOL),
    "fn_concat_vec": (q_fn_concat_vec, SQL_FN_CONCAT_VEC),
    "ml_nb_params": (q_ml_nb_params, SQL_ML_NB_PARAMS),
    "jn_index_vectors": (q_jn_index_vectors, SQL_JN_INDEX_VECTORS),
}
