"""Query catalogue: parsers, filters and lookups of the readers and writers, run on the given
tables (texts in the readers' formats are derived from their columns inside the query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.operators import evaluate as ev
from corpusrisk.operators import lineage as ln
from corpusrisk.operators import models as md
from corpusrisk.operators import report as rp
from corpusrisk.operators import sampling as sp
from corpusrisk.operators.prefix import running_sum
from corpusrisk.plans.tables import label_text, load
from corpusrisk.sinks import writers as wr
from corpusrisk.sources import readers as rd

# ---------------------------------------------------------------------------------------------- feeds

FILE_CUSTOMERS = 10_000  # customers a part of a feed file stands for
FILE_ORDERS = 100_000  # order keys a run file stands for
COMMIT_URL = "https://github.com/torvalds/linux/commit/"


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as feed files of JSON text, parsed with the feed's schema: an order is a reference
    (every third not a CONFIRM one), a customer's orders of one status are an item, a status and
    year a file.  A file comes in as many parts as its range of customers asks for (``FILE_CUSTOMERS``
    each), in their order, with ``before``, the number of items in earlier parts."""
    o = load(spark, sf, "orders").withColumn("file_name", F.concat_ws("-", F.lit("feed"), "o_orderstatus", F.year("o_orderdate").cast("string")))
    source = F.when(F.col("o_orderkey") % 3 == 0, "MISC").otherwise("CONFIRM")
    url = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string"))).otherwise(
        F.concat(F.lit(COMMIT_URL), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 12))
    )
    refs = F.collect_list(F.struct("o_orderkey", F.struct(url.alias("url"), source.alias("refsource")).alias("r")))
    items = o.groupBy("file_name", "o_custkey").agg(F.transform(F.array_sort(refs), lambda x: x["r"]).alias("refs"))
    cve = F.struct(
        F.struct(F.concat(F.lit("CVE-"), F.col("o_custkey").cast("string")).alias("ID")).alias("CVE_data_meta"),
        F.struct(F.col("refs").alias("reference_data")).alias("references"),
        F.struct(F.array(F.struct(F.concat(F.lit("the f_"), F.col("o_custkey").cast("string"), F.lit(" function in net/c"), F.col("o_custkey").cast("string"), F.lit(".c allows")).alias("value"))).alias("description_data")).alias("description"),
    )
    part = F.floor(F.col("o_custkey") / F.lit(FILE_CUSTOMERS)).alias("part")
    files = items.groupBy("file_name", part).agg(F.array_sort(F.collect_list(F.struct(F.col("o_custkey"), F.struct(cve.alias("cve")).alias("i")))).alias("s"))
    text = F.to_json(F.struct(F.transform("s", lambda x: x["i"]).alias("CVE_Items")))
    counts = o.select("file_name", part, "o_custkey").distinct().groupBy("file_name", "part").agg(F.count(F.lit(1)).alias("n"))
    before = running_sum(counts, ["file_name"], ["part"], ["n"], "upto_").select("file_name", "part", (F.col("upto_n") - F.col("n")).cast("long").alias("before"))
    parsed = files.select("file_name", "part", F.from_json(text, rd.FEED_SCHEMA)["CVE_Items"].alias("CVE_Items"))
    return parsed.join(before, ["file_name", "part"])


def items_of(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the feed with their places in the whole file."""
    parts = feed(spark, sf)
    one = parts.select(F.struct("file_name", "before").alias("file_name"), "CVE_Items")
    placed = ln.feed_items(one).withColumn("item_pos", (F.col("file_name.before") + F.col("item_pos")).cast("int"))
    return placed.withColumn("file_name", F.col("file_name.file_name"))


def q_src_feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """``src_feed`` + ``src_feed_items`` + ``fn_find_all``: items with their places, fix commits and names."""
    r = ln.advisory_records(items_of(spark, sf))
    return r.select("file_name", "item_pos", "cve_id", F.array_join(F.array_sort("fix_commits"), ",").alias("fix_commits"), F.array_join("desc_files", ",").alias("files"), F.array_join("desc_functions", ",").alias("functions"))


SQL_FEED = f"""
o AS (SELECT o_orderkey, o_custkey, 'feed-' || o_orderstatus || '-' || year(o_orderdate) AS file_name,
             CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN substr(md5(o_orderkey::VARCHAR), 1, 12) END AS fix FROM orders),
it AS (SELECT file_name, o_custkey, list_sort(list_distinct(list(fix) FILTER (WHERE fix IS NOT NULL))) AS fixes FROM o GROUP BY file_name, o_custkey),
items AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY o_custkey) - 1 AS item_pos FROM it)
"""
SQL_SRC_FEED_ITEMS = f"""WITH {SQL_FEED}
SELECT file_name, item_pos::INTEGER AS item_pos, 'CVE-' || o_custkey AS cve_id, coalesce(array_to_string(fixes, ','), '') AS fix_commits,
       'net/c' || o_custkey || '.c' AS files, 'f_' || o_custkey AS functions FROM items"""


def q_flt_has_commits(spark: SparkSession, sf: str) -> DataFrame:
    """``flt_has_commits`` + ``agg_last_wins``: the last file's item with fix commits per advisory."""
    a = ln.latest_advisories(ln.advisory_records(items_of(spark, sf)))
    return a.select("cve_id", F.array_join(F.array_sort("fix_commits"), ",").alias("fix_commits"))


SQL_FLT_HAS_COMMITS = f"""WITH {SQL_FEED}
SELECT 'CVE-' || o_custkey AS cve_id, array_to_string(arg_max(fixes, file_name), ',') AS fix_commits FROM items WHERE len(fixes) > 0 GROUP BY o_custkey"""


# ---------------------------------------------------------------------------------------------- blame tree


def lineage_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Orders as fix commits of their customers, their lines as blamed lines of parts."""
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    key = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    fixes = o.select(F.concat(F.lit("CVE-"), F.col("o_custkey").cast("string")).alias("cve_id"), key.alias("fix_commit_hash"))
    lines = li.select(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("affecting_commit_hash"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("affected_file"),
        F.col("l_linenumber").cast("int").alias("affected_line"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("affected_line_blame_commit_hash"),
    )
    details = o.select(key.alias("commit_hash"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("committed_timestamp"), F.lit(None).cast("string").alias("parent_commit_hash"))
    return {"fix_commits": fixes, "commit_affected_lines": lines, "commit_details": details}


def blame_text(spark: SparkSession, sf: str) -> DataFrame:
    t = lineage_tables(spark, sf)
    none = F.array().cast("array<string>")
    advisories = t["fix_commits"].select("cve_id").distinct().select("cve_id", none.alias("desc_files"), none.alias("desc_functions"))
    tree = ln.blame_tree(t, advisories)
    parsed = tree.select(F.from_json(F.to_json(F.struct(*tree.columns)), rd.BLAME_SCHEMA).alias("t"))
    return parsed.select("t.*")


def q_dif_cve_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """``snk_blame_json`` + ``src_blame_json`` + ``dif_cve_flatten``: the nested tree as JSON text,
    parsed and flattened back to blamed lines."""
    return ln.flatten_blame_tree(blame_text(spark, sf))["commit_affected_lines"]


SQL_DIF_CVE_FLATTEN = """SELECT 'c' || l_orderkey AS affecting_commit_hash, 'p' || l_partkey AS affected_file, l_linenumber::INTEGER AS affected_line,
 's' || l_suppkey AS affected_line_blame_commit_hash FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""


def q_src_blame_json(spark: SparkSession, sf: str) -> DataFrame:
    return ln.flatten_blame_tree(blame_text(spark, sf))["fix_commits"]


SQL_SRC_BLAME_JSON = "SELECT 'CVE-' || o_custkey AS cve_id, 'c' || o_orderkey AS fix_commit_hash FROM orders"


# ---------------------------------------------------------------------------------------------- line diff branches


def q_dif_deleted_file(spark: SparkSession, sf: str) -> DataFrame:
    """``dif_deleted_file`` + ``flt_change_type``: a deleted document blames all its lines, an added
    one none, a renamed one without a change none."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    kind = F.element_at(F.array(F.lit("D"), F.lit("A"), F.lit("R")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.col("doc_id").cast("string")
    fv = d.select(name.alias("commit_hash"), kind.alias("change_type"), name.alias("a_path"), name.alias("b_path"), F.col("text").alias("a_text"), F.when(kind != "D", F.col("text")).alias("b_text"))
    return ln.changed_lines(fv).select("commit_hash", "line_no")


SQL_DIF_DELETED_FILE = """SELECT doc_id::VARCHAR AS commit_hash, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line_no
FROM documents WHERE doc_id % 3 = 0"""


# ---------------------------------------------------------------------------------------------- indexes and lookups


def q_src_index(spark: SparkSession, sf: str) -> DataFrame:
    """``src_index``: split and part of index file names; every third has no split."""
    d = load(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(".csv"))).when(F.col("doc_id") % 3 == 1, F.concat_ws("_", "source", F.concat("lang", F.lit(".csv")))).otherwise(F.concat_ws("_", "source", "lang", F.lit("x.csv")))
    split, part = rd.index_name_parts(name)
    return d.select("doc_id", split.alias("split"), part.alias("part"))


SQL_SRC_INDEX = "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS split, lang AS part FROM documents"


def index(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "labels").select(F.col("doc_id").alias("file"), label_text(F.col("quality")).alias("label"))


def content(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))


def q_jn_index_content(spark: SparkSession, sf: str) -> DataFrame:
    """``jn_index_content``: every indexed file with its content; a missing one would raise."""
    return rd.attach_content(index(spark, sf), content(spark, sf)).select("file", "label", F.md5("content").alias("content_md5"))


SQL_JN_INDEX_CONTENT = """SELECT l.doc_id AS file, CASE WHEN quality = 0 THEN 'VULNERABLE' ELSE 'NOT_VULNERABLE' END AS label, md5(text) AS content_md5
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def q_jn_strict_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """``jn_strict_lookup``: the nation of every customer; a key without an entry would raise."""
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return ev.strict_lookup(c, load(spark, sf, "nation"), "n_nationkey", "n_name").select("c_custkey", "n_name")


SQL_JN_STRICT_LOOKUP = "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"


def q_prj_label_translate(spark: SparkSession, sf: str) -> DataFrame:
    """``prj_label_translate``: document types (here from order status) to labels."""
    kind = F.when(F.col("o_orderstatus") == "F", ev.VULNERABLE_FILE).otherwise(F.concat(F.lit("TYPE_"), F.col("o_orderstatus")))
    return load(spark, sf, "orders").select("o_orderkey", ev.translate_label(kind).alias("label"))


SQL_PRJ_LABEL_TRANSLATE = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'VULNERABLE' ELSE 'NOT_VULNERABLE' END AS label FROM orders"


def q_fn_time_key(spark: SparkSession, sf: str) -> DataFrame:
    """``fn_time_key``: split keys without their prefix, once per distinct key."""
    name = F.when(F.month("o_orderdate") > 6, F.concat(F.lit("Time_"), F.date_format("o_orderdate", "yyyy-MM"))).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return load(spark, sf, "orders").select(sp.time_key(name).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


SQL_FN_TIME_KEY = "SELECT strftime(o_orderdate, '%Y-%m') AS split, count(*) AS n FROM orders GROUP BY 1"


# ---------------------------------------------------------------------------------------------- results


def order_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as scored examples: status F is class 1, the price's cents are the score."""
    return load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("split"), F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(1000)) / F.lit(1000.0)).alias("score"),
    )


def q_src_runs(spark: SparkSession, sf: str) -> DataFrame:
    """``src_runs``: positional ``[id, label, score]`` triples from JSON text, cast; a split's runs are
    files of ``FILE_ORDERS`` order keys each."""
    return parsed_runs(run_files(spark, sf))


def run_files(spark: SparkSession, sf: str) -> DataFrame:
    s = order_scores(spark, sf).withColumn("file", F.floor(F.col("id").cast("long") / F.lit(FILE_ORDERS)))
    return s.groupBy("split", "file").agg(F.collect_list(F.array("id", F.col("label").cast("string"), F.col("score").cast("string"))).alias("examples"))


def parsed_runs(runs: DataFrame) -> DataFrame:
    parsed = runs.select("split", F.from_json(F.to_json(F.struct(F.struct("examples").alias("test"))), rd.RUN_SCHEMA).alias("r"))
    return parsed.select("split", F.explode("r.test.examples").alias("e")).select("split", *rd.example_columns(F.col("e")))


_SCORES = "SELECT o_orderpriority AS split, o_orderkey::VARCHAR AS id, (o_orderstatus = 'F')::INTEGER AS label, (round(o_totalprice * 100)::BIGINT % 1000) / 1000.0 AS score FROM orders"
SQL_SRC_RUNS = _SCORES


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = order_scores(spark, sf).withColumn("pred", ev.predicted_class("score"))
    return ev.prf(ev.confusion(s, ["split"]))


def q_src_stats(spark: SparkSession, sf: str) -> DataFrame:
    """``snk_stats`` + ``src_stats``: metric lines as text, parsed back to keys and values."""
    lines = wr.stats_lines(metrics(spark, sf))
    key, value = rd.stats_line(F.col("value"))
    return lines.select("split", key.alias("key"), value.alias("v")).select("split", "key", F.col("v").alias("value"))


_CONF = f"""sc AS ({_SCORES}),
cf AS (SELECT split, count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score > 0.5) AS fp,
              count(*) FILTER (WHERE label = 0 AND score <= 0.5) AS tn, count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn FROM sc GROUP BY split),
pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall FROM cf)"""
SQL_SRC_STATS = f"""WITH {_CONF}
SELECT split, unnest(['TP', 'TN', 'FP', 'FN', 'precision', 'recall', 'F1']) AS key,
       unnest([tp::DOUBLE, tn::DOUBLE, fp::DOUBLE, fn::DOUBLE, precision, recall, coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0.0)]) AS value FROM pr"""


def q_rep_baseline_join(spark: SparkSession, sf: str) -> DataFrame:
    """``rep_baseline_join``: all splits' precision and recall beside those of all orders."""
    curve = rp.unpivot_metrics(metrics(spark, sf), ["split"], ["precision", "recall"])
    whole = ev.prf(ev.confusion(order_scores(spark, sf).withColumn("pred", ev.predicted_class("score")).withColumn("all", F.lit("all")), ["all"]))
    stats = rp.unpivot_metrics(whole, ["all"], ["precision", "recall"], "key", "value")
    return rp.baseline_lines(curve, stats).select("split", "metric", "score", "baseline")


SQL_REP_BASELINE_JOIN = f"""WITH {_CONF},
al AS (SELECT coalesce(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp), 0), 0.0) AS p, coalesce(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0), 0.0) AS r FROM cf)
SELECT split, 'precision' AS metric, precision AS score, p AS baseline FROM pr, al UNION ALL SELECT split, 'recall', recall, r FROM pr, al"""


def q_fn_stack(spark: SparkSession, sf: str) -> DataFrame:
    """``fn_stack``: vectors of one width as model features (another width would raise)."""
    e = load(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    width = md.assert_equal_width(e, "embedding")
    f = md.model_frame(e, "embedding", "y", 2.0, "vec_id")
    return f.select("file", F.lit(width).alias("width"), md.LABEL, md.WEIGHT)


SQL_FN_STACK = """SELECT vec_id AS file, len(embedding)::INTEGER AS width, (label < 5)::INTEGER::DOUBLE AS label, CASE WHEN label < 5 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM embeddings"""


QUERIES = {
    "src_feed_items": (q_src_feed_items, SQL_SRC_FEED_ITEMS),
    "flt_has_commits": (q_flt_has_commits, SQL_FLT_HAS_COMMITS),
    "dif_cve_flatten": (q_dif_cve_flatten, SQL_DIF_CVE_FLATTEN),
    "src_blame_json": (q_src_blame_json, SQL_SRC_BLAME_JSON),
    "dif_deleted_file": (q_dif_deleted_file, SQL_DIF_DELETED_FILE),
    "src_index": (q_src_index, SQL_SRC_INDEX),
    "jn_index_content": (q_jn_index_content, SQL_JN_INDEX_CONTENT),
    "jn_strict_lookup": (q_jn_strict_lookup, SQL_JN_STRICT_LOOKUP),
    "prj_label_translate": (q_prj_label_translate, SQL_PRJ_LABEL_TRANSLATE),
    "fn_time_key": (q_fn_time_key, SQL_FN_TIME_KEY),
    "src_runs": (q_src_runs, SQL_SRC_RUNS),
    "src_stats": (q_src_stats, SQL_SRC_STATS),
    "rep_baseline_join": (q_rep_baseline_join, SQL_REP_BASELINE_JOIN),
    "fn_stack": (q_fn_stack, SQL_FN_STACK),
}
