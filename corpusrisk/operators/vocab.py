"""Token counting, vocabularies and vectorising (job D).

All operators work on the exploded token table ``(doc, pos, token)``: the per-document stage is a
partial (map-side) aggregation, so a token that occurs in a third of all rows never reaches one
task un-aggregated, and no document's token list is shipped anywhere except its own group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrisk.operators.prefix import dense_index
from corpusrisk.session import broadcast_if_small, pin


FIRST = "first"


def explode_tokens(df: DataFrame, doc: str, tokens: Column | str, pos: str = "pos", token: str = "token", keep: list[str] | None = None) -> DataFrame:
    """``(doc, tokens ARRAY)`` -> ``(doc, pos, token, first)`` with 0-based positions; ``first`` marks
    the first occurrence of the token in its document (tokens are sorted inside the row, so no
    document is ever regrouped to count it)."""
    tok = F.col(tokens) if isinstance(tokens, str) else tokens
    cols = [doc] + list(keep or [])
    # the tokenising expression is evaluated once: it is referred to twice below
    ordered = df.select(*cols, tok.alias("_t")).select(*cols, F.array_sort(F.transform("_t", lambda t, i: F.struct(t.alias("t"), i.alias("p")))).alias("_s"))
    new = lambda x, k: F.struct(x["t"].alias("t"), x["p"].alias("p"), (~x["t"].eqNullSafe(F.get("_s", k - 1)["t"]) | (k == 0)).alias("f"))
    rows = ordered.select(*cols, F.explode(F.transform("_s", new)).alias("_x"))
    return rows.select(*cols, F.col("_x.p").alias(pos), F.col("_x.t").alias(token), F.col("_x.f").alias(FIRST))


def occurrences() -> Column:
    return F.count(F.lit(1)).cast("long").alias("occurrences")


def documents() -> Column:
    return F.sum(F.col(FIRST).cast("long")).alias("documents")


def token_counts(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``agg_token_counts``: per token, corpus occurrences and number of documents, of
    :func:`explode_tokens` rows.  One aggregation by token: tasks send one row per token."""
    return tokens.groupBy(token).agg(occurrences(), documents())


def vocab_threshold(counts: DataFrame, min_occurrences: int, min_documents: int) -> DataFrame:
    """``agg_vocab_threshold``: tokens with occurrences >= a and documents >= b (a HAVING)."""
    return counts.filter((F.col("occurrences") >= min_occurrences) & (F.col("documents") >= min_documents))


def first_seen_vocab(
    tokens: DataFrame,
    doc_ord: str = "doc_ord",
    pos: str = "pos",
    token: str = "token",
    min_occurrences: int = 1,
    min_documents: int = 1,
) -> DataFrame:
    """``win_first_seen_id`` + ``agg_vocab_threshold``: ``(token, id, occurrences, documents)``
    with dense ids 0..n-1 in order of first appearance (document order, then position)."""
    seen = F.when(F.col(FIRST), F.col(doc_ord))  # one row per token and document
    agg = tokens.groupBy(token).agg(occurrences(), documents(), F.min(doc_ord).alias("_o"), F.min_by(pos, seen).alias("_p"))
    kept = vocab_threshold(agg, min_occurrences, min_documents)
    return dense_index(kept, ["_o", "_p"], out="id").select(token, "id", "occurrences", "documents")


def alpha_vocab(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``win_alpha_id``: every distinct token with a dense id in binary (code point) order."""
    distinct = tokens.select(token).distinct()
    return dense_index(distinct, [token], out="id").select(token, "id")


def topk_vocab(tokens: DataFrame, k: int, doc_ord: str = "doc_ord", pos: str = "pos", token: str = "token") -> DataFrame:
    """``agg_topk_vocab``: the k most frequent tokens, ties in first-seen order; id = rank
    starting at 1 (0 is padding, k+1 unknown).  The limit is the feature (a top-k report)."""
    agg = tokens.groupBy(token).agg(F.count(F.lit(1)).cast("long").alias("occurrences"), F.min(F.struct(F.col(doc_ord).alias("o"), F.col(pos).alias("p"))).alias("_first"))
    rank = [F.desc("occurrences"), F.col("_first.o"), F.col("_first.p")]
    top = agg.orderBy(*rank).limit(k)  # TakeOrderedAndProject: k rows per task at most
    # numbering k rows (k is the bounded feature size) in one window is cheap
    ided = top.withColumn("id", F.row_number().over(Window.orderBy(*rank)))
    return ided.select(token, F.col("id").cast("int").alias("id"), "occurrences")


def vocab_side(vocab: DataFrame) -> DataFrame:
    """The vocabulary as a join side: pinned, and broadcast only when its bytes are measured to be
    few; larger ones take the shuffle join, where AQE splits skewed token partitions.  Prepare
    once and pass it to several lookups with ``prepared=True``."""
    return broadcast_if_small(pin(vocab))


_vocab_side = vocab_side


def lookup_ids(tokens: DataFrame, vocab: DataFrame, unk: int | Column, token: str = "token", out: str = "id", prepared: bool = False) -> DataFrame:
    """``jn_vocab``: token -> id, a miss -> ``unk``."""
    v = vocab.select(F.col(token), F.col("id").alias("_vid"))
    v = v if prepared else vocab_side(v)
    u = unk if isinstance(unk, Column) else F.lit(unk)
    return tokens.join(v, token, "left").withColumn(out, F.coalesce(F.col("_vid").cast("long"), u.cast("long"))).drop("_vid")


def regroup(ids: DataFrame, doc: str = "doc", pos: str = "pos", value: str = "id", out: str = "vector") -> DataFrame:
    """Exploded ``(doc, pos, value)`` back to ``(doc, ARRAY<value>)`` in position order.

    A group is one document, bounded by the document's own length."""
    return ids.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))), lambda s: s["v"]).alias(out))


def regroup_arrays(df: DataFrame, doc: str = "doc", values: str = "ids", out: str = "vector") -> DataFrame:
    """:func:`regroup` of rows ``(doc, ARRAY)`` that are still whole: what exploding them with their positions
    and regrouping gives.  Elements move as arrays; only a document of several rows is sorted."""
    rows = df.filter(F.size(values) > 0).groupBy(doc).agg(F.collect_list(values).alias("_a"))
    placed = F.flatten(F.transform("_a", lambda a: F.transform(a, lambda v, i: F.struct(i.alias("p"), v.alias("v")))))
    return rows.select(doc, F.when(F.size("_a") == 1, F.col("_a")[0]).otherwise(F.transform(F.array_sort(placed), lambda s: s["v"])).alias(out))


def vectorise(tokens: DataFrame, vocab: DataFrame, unk: int, doc: str = "doc", pos: str = "pos", token: str = "token", prepared: bool = False) -> DataFrame:
    """``ft_vocab_vectorise`` (apply step): per document the id vector, unknown tokens -> ``unk``."""
    return regroup(lookup_ids(tokens, vocab, unk, token=token, prepared=prepared), doc=doc, pos=pos, value="id", out="vector")


def doc_term_counts(tokens: DataFrame, vocab: DataFrame, doc: str = "doc", token: str = "token") -> DataFrame:
    """``agg_doc_terms`` / ``ft_bow``: ``(doc, idx, cnt)`` over the fitted vocabulary only."""
    counts = tokens.groupBy(doc, token).agg(F.count(F.lit(1)).cast("long").alias("cnt"))
    v = _vocab_side(vocab.select(F.col(token), F.col("id").alias("idx")))
    return counts.join(v, token, "inner").select(doc, "idx", "cnt")
