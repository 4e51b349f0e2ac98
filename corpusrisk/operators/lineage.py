"""Advisory feeds -> fix commits -> changed lines -> blamed (introducing) commits (job A).

Inputs are tables: the parsed feed (see :mod:`corpusrisk.sources.feeds`), ``commits(commit_hash,
committed_timestamp, parents)``, ``file_versions(commit_hash, change_type, a_path, b_path,
a_text, b_text)`` (each fix commit against its first parent) and ``blame(commit_hash, path,
line_no, blame_commit)``.  Git access itself is outside the library.

The sequential line diff is in :mod:`corpusrisk.operators.linediff`.  The one here is the *set form*: equal lines are numbered by occurrence and matched by
``(file, text, occurrence)``; an old line without a partner is deleted or replaced.  A run of
new lines inserted between two consecutive old lines blames those two neighbours (line 0 and
n + 1 then match no blame row).  Unlike a sequential matcher, a moved line counts as unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrisk.functions import text as tx

# Fixed value: advisories with more fix commits than this are dropped
MAX_FIX_COMMITS = 4


# ---------------------------------------------------------------------------------------------- feeds


def feed_items(feed: DataFrame) -> DataFrame:
    """``src_feed_items``: one row per advisory item with its file name and position in file."""
    return feed.select(F.col("file_name"), F.posexplode("CVE_Items").alias("item_pos", "item")).select(
        "file_name", "item_pos", F.col("item.cve.CVE_data_meta.ID").alias("cve_id"), F.col("item.cve").alias("cve")
    )


def fix_commit_set(references: Column) -> Column:
    """``flt_confirm_fix`` + ``agg_set``: distinct hashes of CONFIRM references whose URL matches
    the fix-commit pattern (array order is not meaningful)."""
    hashes = F.transform(
        F.filter(references, lambda r: (r["refsource"] == F.lit(tx.FIX_COMMIT_SOURCE)) & r["url"].rlike(tx.FIX_COMMIT_URL)),
        lambda r: F.regexp_extract(r["url"], tx.FIX_COMMIT_URL, tx.FIX_COMMIT_GROUP),
    )
    return F.array_distinct(hashes)


def desc_matches(descriptions: Column, fn) -> Column:
    """``fn_find_all`` over every description value, flattened in order."""
    return F.flatten(F.transform(descriptions, lambda d: fn(d["value"])))


def advisory_records(items: DataFrame) -> DataFrame:
    """Per item: fix commits, ``.c`` files and function names mentioned in the description."""
    desc = F.col("cve.description.description_data")
    return items.select(
        "file_name",
        "item_pos",
        "cve_id",
        fix_commit_set(F.col("cve.references.reference_data")).alias("fix_commits"),
        desc_matches(desc, tx.find_desc_files).alias("desc_files"),
        desc_matches(desc, tx.find_desc_functions).alias("desc_functions"),
    )


def latest_advisories(records: DataFrame) -> DataFrame:
    """``flt_has_commits`` then ``agg_last_wins``: items without fix commits never replace a
    record; otherwise the item in the latest file (then latest position) wins."""
    has = records.filter(F.size("fix_commits") > 0)
    order = F.struct("file_name", "item_pos")
    return has.groupBy("cve_id").agg(*[F.max_by(c, order).alias(c) for c in ("fix_commits", "desc_files", "desc_functions")])


def drop_many_commits(advisories: DataFrame, max_fix_commits: int = MAX_FIX_COMMITS) -> DataFrame:
    """``flt_max_commits``: keep advisories with at most ``max_fix_commits`` distinct fix
    commits, counted before missing commits are removed."""
    return advisories.filter(F.size("fix_commits") <= max_fix_commits)


def valid_fix_commits(advisories: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``jn_valid_commits``: ``(cve_id, fix_commit_hash)`` present in the repository, and the
    missing ones as a second output (left-anti)."""
    fc = advisories.select("cve_id", F.explode("fix_commits").alias("fix_commit_hash"))
    known = commits.select(F.col("commit_hash").alias("fix_commit_hash"))
    return fc.join(known, "fix_commit_hash", "left_semi"), fc.join(known, "fix_commit_hash", "left_anti")


def first_parent(parents: Column) -> Column:
    """``fn_first_parent``: first parent or null."""
    return F.get(parents, F.lit(0))  # null when there is no parent


# ---------------------------------------------------------------------------------------------- line diff


def checked_versions(file_versions: DataFrame) -> DataFrame:
    """``flt_change_type``: added files are ignored; M, D, R are diffed; anything else raises."""
    ct = F.col("change_type")
    fv = file_versions.filter(ct != "A")
    return fv.withColumn("change_type", F.when(ct.isin("M", "D", "R"), ct).otherwise(F.raise_error(F.concat(F.lit("unexpected change type: "), ct))))


def numbered_lines(df: DataFrame, keys: list[str], text: str, no: str = "line_no") -> DataFrame:
    """``dif_split_lines``: ``(keys, line_no 1-based, line, occ)``; ``occ`` numbers equal lines of
    one file (a group is one file's copies of one line).  Null (undecodable) text has no lines."""
    lines = df.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(tx.split_lines(text)).alias("_p", "line"))
    lines = lines.withColumn(no, (F.col("_p") + 1).cast("int")).drop("_p")
    w = Window.partitionBy(*keys, "line").orderBy(no)
    return lines.withColumn("occ", F.row_number().over(w))


def changed_lines(file_versions: DataFrame, keys: tuple[str, ...] = ("commit_hash", "a_path")) -> DataFrame:
    """``dif_changed_lines`` + ``dif_insert_anchor`` + ``dif_deleted_file``: the old-version line
    numbers a change blames, ``(keys, line_no)``, distinct."""
    keys = list(keys)
    fv = checked_versions(file_versions)
    deleted = numbered_lines(fv.filter(F.col("change_type") == "D"), keys, "a_text").select(*keys, "line_no")
    mod = fv.filter(F.col("change_type") != "D")
    old = numbered_lines(mod, keys, "a_text", "old_no")
    new = numbered_lines(mod, keys, "b_text", "new_no")
    removed = old.join(new, keys + ["line", "occ"], "left_anti").select(*keys, F.col("old_no").alias("line_no"))
    # new side: old partner of each line, then the neighbours of every unmatched run
    paired = new.join(old, keys + ["line", "occ"], "left").select(*keys, "new_no", "old_no")
    n_old = old.groupBy(*keys).agg(F.max("old_no").alias("n_old"))
    before = Window.partitionBy(*keys).orderBy("new_no").rowsBetween(Window.unboundedPreceding, -1)
    # looking forward is looking back in descending order: one pass, not a new scan per row
    after = Window.partitionBy(*keys).orderBy(F.desc("new_no")).rowsBetween(Window.unboundedPreceding, -1)
    gaps = (
        paired.withColumn("prev_old", F.coalesce(F.last("old_no", ignorenulls=True).over(before), F.lit(0)))
        .withColumn("next_old", F.last("old_no", ignorenulls=True).over(after))
        .filter(F.col("old_no").isNull())
        .join(n_old, keys, "left")
        .withColumn("next_old", F.coalesce(F.col("next_old"), F.coalesce(F.col("n_old"), F.lit(0)) + 1))
        .filter(F.col("next_old") == F.col("prev_old") + 1)
    )
    anchors = gaps.select(*keys, F.explode(F.array("prev_old", "next_old")).alias("line_no"))
    return deleted.unionByName(removed).unionByName(anchors.select(*keys, F.col("line_no").cast("int"))).distinct()


def blame_lines(changed: DataFrame, commits: DataFrame, blame: DataFrame) -> DataFrame:
    """``jn_blame`` / ``dif_blame``: blamed lines -> the commit that last touched each of them in
    the fix commit's first parent.  ``(commit_hash, path, line_no, blame_commit)``; lines with no
    blame row (0, n + 1) drop out."""
    parents = commits.select("commit_hash", first_parent(F.col("parents")).alias("parent"))
    c = changed.withColumnRenamed("a_path", "path").join(parents, "commit_hash")
    b = blame.select(F.col("commit_hash").alias("parent"), "path", "line_no", "blame_commit")
    return c.join(b, ["parent", "path", "line_no"]).select("commit_hash", "path", "line_no", "blame_commit")


# ---------------------------------------------------------------------------------------------- tables


def relational_tables(valid: DataFrame, blamed: DataFrame, commits: DataFrame) -> dict[str, DataFrame]:
    """``dif_cve_flatten`` / ``snk_relational`` / ``jn_commit_details``: the three flat tables."""
    fix_commits = valid.select("cve_id", "fix_commit_hash")
    affected = blamed.select(
        F.col("commit_hash").alias("affecting_commit_hash"),
        F.col("path").alias("affected_file"),
        F.col("line_no").cast("int").alias("affected_line"),
        F.col("blame_commit").alias("affected_line_blame_commit_hash"),
    )
    return {"fix_commits": fix_commits, "commit_affected_lines": affected, "commit_details": commit_details(fix_commits, affected, commits)}


def commit_details(fix_commits: DataFrame, affected: DataFrame, commits: DataFrame) -> DataFrame:
    """``set_union_distinct`` + ``jn_commit_details``: details of every distinct fix or blame
    commit; unresolvable commits are skipped; first parent or null."""
    hashes = fix_commits.select(F.col("fix_commit_hash").alias("commit_hash")).union(affected.select(F.col("affected_line_blame_commit_hash").alias("commit_hash"))).distinct()
    return hashes.join(commits, "commit_hash").select("commit_hash", "committed_timestamp", first_parent(F.col("parents")).alias("parent_commit_hash"))


def introducers(tables: dict[str, DataFrame]) -> DataFrame:
    """``dif_introducers``: per advisory the fix commits, blamed lines, introducing commits and
    the time span of the introducing commits that resolve."""
    fc, al, cd = tables["fix_commits"], tables["commit_affected_lines"], tables["commit_details"]
    j = fc.join(al, fc.fix_commit_hash == al.affecting_commit_hash, "left")
    j = j.join(cd.select(F.col("commit_hash").alias("affected_line_blame_commit_hash"), F.to_timestamp("committed_timestamp").alias("t")), "affected_line_blame_commit_hash", "left")
    return j.groupBy("cve_id").agg(
        F.count_distinct("fix_commit_hash").alias("n_fix_commits"),
        F.count("affected_line").alias("n_lines"),
        F.count_distinct("affected_line_blame_commit_hash").alias("n_introducing_commits"),
        F.min("t").alias("first_introduced"),
        F.max("t").alias("last_introduced"),
    )


def blame_tree(tables: dict[str, DataFrame], advisories: DataFrame) -> DataFrame:
    """``snk_blame_json``: the nested advisory -> fix commit -> file -> lines tree, built last
    from the flat rows (each group is one advisory / commit / file)."""
    fc, al, cd = tables["fix_commits"], tables["commit_affected_lines"], tables["commit_details"]
    files = al.groupBy("affecting_commit_hash", "affected_file").agg(
        F.array_sort(F.collect_list(F.struct(F.col("affected_line").alias("line_no"), F.col("affected_line_blame_commit_hash").alias("blame_commit")))).alias("blame_lines")
    )
    per_commit = files.groupBy("affecting_commit_hash").agg(F.map_from_entries(F.collect_list(F.struct("affected_file", F.struct("blame_lines")))).alias("affected_files"))
    commits = (
        fc.join(per_commit, fc.fix_commit_hash == per_commit.affecting_commit_hash, "left")
        .join(cd.select(F.col("commit_hash").alias("fix_commit_hash"), "committed_timestamp"), "fix_commit_hash", "left")
        .select("cve_id", "fix_commit_hash", F.struct("committed_timestamp", F.coalesce("affected_files", F.create_map().cast("map<string,struct<blame_lines:array<struct<line_no:int,blame_commit:string>>>>")).alias("affected_files")).alias("d"))
    )
    per_cve = commits.groupBy("cve_id").agg(F.map_from_entries(F.collect_list(F.struct("fix_commit_hash", "d"))).alias("fix_commits"))
    return advisories.select("cve_id", F.col("desc_files").alias("cve_desc_files"), F.col("desc_functions").alias("cve_desc_functions")).join(per_cve, "cve_id", "left")


def drop_many_commits_rows(fix_rows: DataFrame, max_fix_commits: int = MAX_FIX_COMMITS, key: str = "cve_id", commit: str = "fix_commit_hash") -> DataFrame:
    """``flt_max_commits`` on exploded ``(cve_id, fix_commit_hash)`` rows: count distinct per
    advisory (partial aggregation, nothing collected), then keep the small advisories."""
    small = fix_rows.groupBy(key).agg(F.count_distinct(commit).alias("n_commits")).filter(F.col("n_commits") <= max_fix_commits)
    return fix_rows.join(small, key, "left_semi")


def flatten_blame_tree(tree: DataFrame) -> dict[str, DataFrame]:
    """``dif_cve_flatten``: the nested advisory tree (as written by :func:`blame_tree` or read
    with ``src_blame_json``) back to ``fix_commits`` and ``commit_affected_lines`` rows
    (``explode`` of the two maps, then ``inline`` of the line structs)."""
    commits = tree.select("cve_id", F.explode("fix_commits").alias("fix_commit_hash", "d"))
    files = commits.select("fix_commit_hash", F.explode("d.affected_files").alias("affected_file", "f"))
    lines = files.select(
        F.col("fix_commit_hash").alias("affecting_commit_hash"), "affected_file", F.inline("f.blame_lines")
    ).select("affecting_commit_hash", "affected_file", F.col("line_no").cast("int").alias("affected_line"), F.col("blame_commit").alias("affected_line_blame_commit_hash"))
    return {"fix_commits": commits.select("cve_id", "fix_commit_hash"), "commit_affected_lines": lines}
