"""Query catalogue, job A: fix-commit URL filter (``pages``), advisories -> fix commits ->
blamed lines -> introducing commits (``customer``/``orders``/``lineitem``), and the set-form line
diff over version pairs of ``documents``.

Stand-ins: advisory = customer, fix commit = order, repository = orders not pending ('P'),
commit time = order date and a time of day from the key, parents = the order before (none for every
tenth order) and one more, blame rows = line items (path = parity of the line, line = line number,
origin = part): a commit's changed lines are looked up in its first parent's line items.
Version pairs = consecutive documents (by id) of one ``source``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.functions import text as tx
from corpusrisk.operators import lineage as ln
from corpusrisk.operators.linediff import sequential_changed_lines
from corpusrisk.operators.prefix import running_sum
from corpusrisk.operators.sampling import iso_timestamp
from corpusrisk.plans.q_text import sq
from corpusrisk.plans.tables import load


def q_flt_confirm_fix(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages")
    return p.select("page_id", tx.fix_commit_hash("url").alias("fix_commit_hash"))


SQL_FLT_CONFIRM_FIX = f"SELECT page_id, CASE WHEN regexp_matches(url, '{sq(tx.FIX_COMMIT_URL)}') THEN regexp_extract(url, '{sq(tx.FIX_COMMIT_URL)}', {tx.FIX_COMMIT_GROUP}) END AS fix_commit_hash FROM pages"


def commits(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    k = F.col("o_orderkey")
    time = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (k % 86400) * 1_000_000 + (k % 3) * 250_000)
    parents = F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(F.array((k - 1).cast("string"), F.lit("other")))
    return o.select(k.cast("string").alias("commit_hash"), iso_timestamp(time.cast("timestamp_ntz")).alias("committed_timestamp"), parents.alias("parents"))


def fix_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("CVE-"), F.col("o_custkey").cast("string")).alias("cve_id"), F.col("o_orderkey").cast("string").alias("fix_commit_hash"))
    return ln.drop_many_commits_rows(rows)


def blame_table(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("commit_hash"),
        (F.col("l_linenumber") % 2).cast("string").alias("path"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").cast("string").alias("blame_commit"),
    )


def tables(spark: SparkSession, sf: str) -> dict:
    c = commits(spark, sf)
    fr = fix_rows(spark, sf)
    valid = fr.join(c.select(F.col("commit_hash").alias("fix_commit_hash")), "fix_commit_hash", "left_semi")
    bt = blame_table(spark, sf)
    # changed lines of each valid fix commit: its line items (the diff itself is dif_changed_lines)
    changed = bt.join(valid.select(F.col("fix_commit_hash").alias("commit_hash")).distinct(), "commit_hash", "left_semi").select(
        "commit_hash", F.col("path").alias("a_path"), "line_no"
    ).distinct()  # blamed lines are a set
    blamed = ln.blame_lines(changed, c, bt)
    return ln.relational_tables(valid, blamed, c)


SQL_LINEAGE = """
cm AS (SELECT CAST(o_orderkey AS VARCHAR) AS commit_hash, ts,
              strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS committed_timestamp,
              CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey - 1 AS VARCHAR) END AS parent
       FROM (SELECT *, make_timestamp(epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 + (o_orderkey % 3) * 250000) AS ts FROM orders) WHERE o_orderstatus <> 'P'),
fr0 AS (SELECT 'CVE-' || CAST(o_custkey AS VARCHAR) AS cve_id, CAST(o_orderkey AS VARCHAR) AS fix_commit_hash FROM orders),
fr AS (SELECT * FROM fr0 WHERE cve_id IN (SELECT cve_id FROM fr0 GROUP BY cve_id HAVING count(DISTINCT fix_commit_hash) <= 4)),
valid AS (SELECT * FROM fr WHERE fix_commit_hash IN (SELECT commit_hash FROM cm)),
bt AS (SELECT CAST(l_orderkey AS VARCHAR) AS commit_hash, CAST(l_linenumber % 2 AS VARCHAR) AS path, l_linenumber AS line_no, CAST(l_partkey AS VARCHAR) AS blame_commit FROM lineitem),
ch AS (SELECT DISTINCT commit_hash, path, line_no FROM bt WHERE commit_hash IN (SELECT fix_commit_hash FROM valid)),
al AS (SELECT ch.commit_hash AS affecting_commit_hash, ch.path AS affected_file, ch.line_no AS affected_line, b.blame_commit AS affected_line_blame_commit_hash
       FROM ch JOIN cm ON cm.commit_hash = ch.commit_hash JOIN bt b ON b.commit_hash = cm.parent AND b.path = ch.path AND b.line_no = ch.line_no),
cd AS (SELECT cm.commit_hash, cm.committed_timestamp, cm.parent AS parent_commit_hash FROM cm
       WHERE cm.commit_hash IN (SELECT fix_commit_hash FROM valid UNION SELECT affected_line_blame_commit_hash FROM al))
"""


def q_flt_max_commits(spark: SparkSession, sf: str) -> DataFrame:
    return fix_rows(spark, sf).groupBy("cve_id").agg(F.count_distinct("fix_commit_hash").alias("n_commits"))


SQL_FLT_MAX_COMMITS = f"WITH {SQL_LINEAGE} SELECT cve_id, count(DISTINCT fix_commit_hash) AS n_commits FROM fr GROUP BY cve_id"


def q_jn_valid_commits(spark: SparkSession, sf: str) -> DataFrame:
    """``jn_valid_commits``: every fix commit of a kept advisory, valid or missing."""
    c = commits(spark, sf)
    fr = fix_rows(spark, sf).select("cve_id", F.array("fix_commit_hash").alias("fix_commits"))
    valid, missing = ln.valid_fix_commits(fr, c)
    return valid.withColumn("valid", F.lit(True)).unionByName(missing.withColumn("valid", F.lit(False)))


SQL_JN_VALID_COMMITS = f"WITH {SQL_LINEAGE} SELECT cve_id, fix_commit_hash, fix_commit_hash IN (SELECT commit_hash FROM cm) AS valid FROM fr"


def q_snk_fix_commits(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)["fix_commits"]


SQL_SNK_FIX_COMMITS = f"WITH {SQL_LINEAGE} SELECT cve_id, fix_commit_hash FROM valid"


def q_jn_blame(spark: SparkSession, sf: str) -> DataFrame:
    """``jn_blame`` -> ``commit_affected_lines``."""
    return tables(spark, sf)["commit_affected_lines"]


SQL_JN_BLAME = f"WITH {SQL_LINEAGE} SELECT affecting_commit_hash, affected_file, affected_line, affected_line_blame_commit_hash FROM al"


def q_jn_commit_details(spark: SparkSession, sf: str) -> DataFrame:
    """``set_union_distinct`` + ``jn_commit_details`` -> ``commit_details``."""
    return tables(spark, sf)["commit_details"]


SQL_JN_COMMIT_DETAILS = f"WITH {SQL_LINEAGE} SELECT commit_hash, committed_timestamp, parent_commit_hash FROM cd"


def q_dif_introducers(spark: SparkSession, sf: str) -> DataFrame:
    micros = [F.unix_micros(c).alias(c) for c in ("first_introduced", "last_introduced")]
    return ln.introducers(tables(spark, sf)).select("cve_id", "n_fix_commits", "n_lines", "n_introducing_commits", *micros)


SQL_DIF_INTRODUCERS = f"""WITH {SQL_LINEAGE}
SELECT v.cve_id, count(DISTINCT v.fix_commit_hash) AS n_fix_commits, count(al.affected_line) AS n_lines,
       count(DISTINCT al.affected_line_blame_commit_hash) AS n_introducing_commits, epoch_us(min(i.ts)) AS first_introduced, epoch_us(max(i.ts)) AS last_introduced
FROM valid v LEFT JOIN al ON v.fix_commit_hash = al.affecting_commit_hash LEFT JOIN cm i ON i.commit_hash = al.affected_line_blame_commit_hash GROUP BY v.cve_id"""


# ---------------------------------------------------------------------------------------------- line diff on documents


def q_dif_split_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    lines = ln.numbered_lines(d, ["doc_id"], "text")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line") == "").alias("n_blank"), F.max("occ").alias("max_repeat"))


SQL_DIF_SPLIT_LINES = """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line = '') AS n_blank, max(occ) AS max_repeat FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) AS occ
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, p)) GROUP BY doc_id
"""


def version_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", "source", "text")
    # rank the keys alone; the texts join the pairs of ids
    ranked = running_sum(d.select("doc_id", "source").withColumn("_one", F.lit(1.0)), ["source"], ["doc_id"], ["_one"]).select("doc_id", "source", F.col("cum__one").cast("long").alias("r"))
    old = ranked.select("source", (F.col("r") + 1).alias("r"), F.col("doc_id").alias("old_id"))
    pairs = ranked.join(old, ["source", "r"]).select("doc_id", "old_id", "source")
    new, before = d.select("doc_id", F.col("text").alias("b_text")), d.select(F.col("doc_id").alias("old_id"), F.col("text").alias("a_text"))
    both = pairs.join(new, "doc_id").join(before, "old_id")
    return both.select(F.col("doc_id").alias("commit_hash"), F.col("source").alias("a_path"), F.lit("M").alias("change_type"), "a_text", "b_text")


def q_dif_changed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ln.changed_lines(version_pairs(spark, sf))


SQL_DIF_CHANGED_LINES = """
WITH r AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
pairs AS (SELECT n.doc_id AS commit_hash, n.source AS a_path, o.text AS a_text, n.text AS b_text FROM r n JOIN r o ON n.source = o.source AND n.r = o.r + 1),
ol AS (SELECT commit_hash, a_path, line, p::INTEGER AS old_no, row_number() OVER (PARTITION BY commit_hash, a_path, line ORDER BY p) AS occ
       FROM pairs, unnest(string_split(a_text, chr(10))) WITH ORDINALITY AS u(line, p)),
nl AS (SELECT commit_hash, a_path, line, p::INTEGER AS new_no, row_number() OVER (PARTITION BY commit_hash, a_path, line ORDER BY p) AS occ
       FROM pairs, unnest(string_split(b_text, chr(10))) WITH ORDINALITY AS u(line, p)),
removed AS (SELECT commit_hash, a_path, old_no AS line_no FROM ol WHERE NOT EXISTS (
       SELECT 1 FROM nl WHERE nl.commit_hash = ol.commit_hash AND nl.a_path = ol.a_path AND nl.line = ol.line AND nl.occ = ol.occ)),
paired AS (SELECT nl.commit_hash, nl.a_path, nl.new_no, ol.old_no FROM nl LEFT JOIN ol USING (commit_hash, a_path, line, occ)),
nold AS (SELECT commit_hash, a_path, max(old_no) AS n_old FROM ol GROUP BY ALL),
g AS (SELECT p.*, coalesce(last_value(old_no IGNORE NULLS) OVER (PARTITION BY commit_hash, a_path ORDER BY new_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_old,
             first_value(old_no IGNORE NULLS) OVER (PARTITION BY commit_hash, a_path ORDER BY new_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_old FROM paired p),
anchors AS (SELECT g.commit_hash, g.a_path, g.prev_old, coalesce(g.next_old, coalesce(nold.n_old, 0) + 1) AS next_old FROM g LEFT JOIN nold USING (commit_hash, a_path) WHERE g.old_no IS NULL)
SELECT DISTINCT commit_hash, a_path, line_no FROM (
  SELECT * FROM removed
  UNION ALL SELECT commit_hash, a_path, unnest([prev_old, next_old])::INTEGER AS line_no FROM anchors WHERE next_old = prev_old + 1)
"""


REPLACED = 7  # every line whose place is a multiple of this is edited


def edited_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in: every document against an edit of it: its first third of lines moved to the end and
    every seventh line replaced.  Lines carry their occurrence number, so that no two are equal."""
    lines = ln.numbered_lines(load(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")
    line = F.concat_ws(" ", F.col("occ").cast("string"), "line")
    cell = F.struct("line_no", line.alias("old"), F.when(F.col("line_no") % REPLACED == 0, F.concat(line, F.lit(" edited"))).otherwise(line).alias("new"))
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))  # one document's lines
    third = F.floor(F.size("c") / 3).cast("int")
    moved = F.concat(F.slice("c", third + 1, F.size("c")), F.slice("c", F.lit(1), third))
    return docs.select(F.col("doc_id").alias("commit_hash"), F.lit("f").alias("a_path"), F.lit("M").alias("change_type"), F.array_join("c.old", "\n").alias("a_text"), F.array_join(F.transform(moved, lambda x: x["new"]), "\n").alias("b_text"))


def q_dif_moved_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``dif_changed_lines`` as a sequential diff of versions with moved and replaced lines."""
    return sequential_changed_lines(edited_versions(spark, sf)).select("commit_hash", "line_no")


# a matched line is an unedited one of the two thirds that stay in order
SQL_DIF_MOVED_LINES = f"""
WITH l AS (SELECT doc_id, p::INTEGER AS p FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, p)),
n AS (SELECT doc_id, max(p) AS n, max(p) // 3 AS k FROM l GROUP BY doc_id),
s AS (SELECT l.doc_id, p, n, k, p > k AND p % {REPLACED} <> 0 AS same, CASE WHEN p > k THEN p - k ELSE n - k + p END AS q FROM l JOIN n ON l.doc_id = n.doc_id),
m AS (SELECT doc_id, n, p, q FROM s WHERE same UNION ALL SELECT doc_id, n, n + 1, n + 1 FROM n UNION ALL SELECT doc_id, n, 0, 0 FROM n),
g AS (SELECT doc_id, p, q, lead(p) OVER w AS np, lead(q) OVER w AS nq FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
b AS (SELECT doc_id, unnest(range(p + 1, np)) AS line_no FROM g WHERE np > p + 1
      UNION ALL SELECT doc_id, unnest([p, np]) FROM g WHERE np = p + 1 AND nq > q + 1)
SELECT DISTINCT doc_id AS commit_hash, line_no::INTEGER AS line_no FROM b
"""


QUERIES = {
    "dif_moved_lines": (q_dif_moved_lines, SQL_DIF_MOVED_LINES),
    "flt_confirm_fix": (q_flt_confirm_fix, SQL_FLT_CONFIRM_FIX),
    "flt_max_commits": (q_flt_max_commits, SQL_FLT_MAX_COMMITS),
    "jn_valid_commits": (q_jn_valid_commits, SQL_JN_VALID_COMMITS),
    "snk_relational_fix_commits": (q_snk_fix_commits, SQL_SNK_FIX_COMMITS),
    "jn_blame": (q_jn_blame, SQL_JN_BLAME),
    "jn_commit_details": (q_jn_commit_details, SQL_JN_COMMIT_DETAILS),
    "dif_introducers": (q_dif_introducers, SQL_DIF_INTRODUCERS),
    "dif_split_lines": (q_dif_split_lines, SQL_DIF_SPLIT_LINES),
    "dif_changed_lines": (q_dif_changed_lines, SQL_DIF_CHANGED_LINES),
}
