"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

1. Each normalised text is cut into content-defined chunks: a chunk ends at the first boundary
   (two characters that depend on nothing but the text there) after ``MIN_CHUNK`` characters, or
   at ``MAX_CHUNK``.  Equal texts give equal chunk lists.
2. Chunks are deduplicated by their content: one distinct over (hash, bytes, content).  A hash
   that stands for one content only is that content's verified identifier; where two contents
   share a hash, the rank of the content among them becomes part of the identifier.
3. A document's recipe is its ordered list of identifiers.  Documents with equal recipes are
   equal texts; grouping, choosing the row that stays and joining back move recipes (about 20
   bytes per chunk), never a text again.

Cases: null text is the empty text (empty recipe, one group).  Of equal texts the smallest
``doc_id`` stays, null ids last; of repeated rows with that id exactly one stays.  Extra columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusrisk.llm.common import SPACE_CLASS, id_text_columns, row_number, stage

MIN_CHUNK, MAX_CHUNK = 512, 8192
# ends a chunk: one of these endings, a space, and (looked at only) a letter of the first half
BOUNDARY = r"[nesr.,] (?=[a-m])"


def chunk_pattern(min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, boundary: str = BOUNDARY) -> str:
    """Matches of this pattern tile any text."""
    return rf"(?s).{{{min_chunk},{max_chunk - 2}}}?{boundary}|.{{1,{max_chunk}}}"


def _chunked(docs: DataFrame, min_chunk: int, max_chunk: int, hash_bits: int, rid_col: str | None = None) -> DataFrame:
    """Rows (rid, doc_id, text_sha256, chunks array<struct<h, n, c>>)."""
    mask = F.lit(-1 if hash_bits >= 64 else (1 << hash_bits) - 1).cast("long")
    normal = F.regexp_replace("text", SPACE_CLASS + "+", " ")
    return (
        docs.select(row_number(rid_col), *id_text_columns())
        .select("rid", "doc_id", normal.alias("text"))
        .select(
            "rid",
            "doc_id",
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.regexp_extract_all("text", F.lit(chunk_pattern(min_chunk, max_chunk)), 0).alias("pieces"),
        )
        .select(
            "rid",
            "doc_id",
            "text_sha256",
            F.transform("pieces", lambda c: F.struct(F.xxhash64(c).bitwiseAND(mask).alias("h"), F.octet_length(c).alias("n"), c.alias("c"))).alias("chunks"),
        )
    )


def recipes(docs: DataFrame, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, hash_bits: int = 64, rid_col: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, text_sha256 and ``recipe``, the ordered list of verified
    chunk identifiers ``struct<h long, n int, v int>`` (hash, bytes, rank among the contents that
    share both; 0 for nearly all).  ``hash_bits`` exists to force shared hashes in tests."""
    chunked = _chunked(docs, min_chunk, max_chunk, hash_bits, rid_col)
    bare = lambda c: F.struct(c["h"].alias("h"), c["n"].alias("n"), F.lit(0).alias("v"))
    unranked = lambda x: x.select("rid", "doc_id", "text_sha256", F.transform("chunks", bare).alias("recipe"))
    base = stage(unranked(chunked), "recipes")
    contents = chunked.select(F.explode("chunks").alias("x")).select("x.h", "x.n", "x.c").distinct()
    shared = stage(contents.groupBy("h", "n").count().filter("count > 1").select("h", "n"), "shared-hashes")
    if shared.isEmpty():
        return base
    # rare: number the contents behind each shared hash and put the number into the identifiers
    if rid_col is None:  # the rows are read again here: their numbers have to be written first
        chunked = stage(chunked, "chunks")
        base = unranked(chunked)
    at = chunked.select("rid", F.posexplode("chunks").alias("pos", "x")).select("rid", "pos", "x.h", "x.n", "x.c").join(shared, ["h", "n"])
    rank = Window.partitionBy("h", "n").orderBy("c")  # as many rows as contents share one hash
    ranks = at.select("h", "n", "c").distinct().withColumn("v", F.row_number().over(rank) - 1)
    fixes = (
        at.join(ranks, ["h", "n", "c"])
        .groupBy("rid")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("fix"))  # at most one per chunk of the document
    )
    with_rank = lambda x, i: F.struct(x["h"].alias("h"), x["n"].alias("n"), F.coalesce(F.try_element_at("fix", i), F.lit(0)).alias("v"))
    fixed = base.join(fixes, "rid", "left").withColumn("recipe", F.when(F.col("fix").isNull(), F.col("recipe")).otherwise(F.transform("recipe", with_rank)))
    return stage(fixed.drop("fix"), "recipes-ranked")


def exact_dedup(docs: DataFrame, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, hash_bits: int = 64, rid_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), n_chunks and rid, the
    row number in ``rid_col`` (or one of a single scan); one row per row of ``docs``."""
    rows = recipes(docs, min_chunk, max_chunk, hash_bits, rid_col)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    groups = rows.groupBy("recipe").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
        "rid",
    )
