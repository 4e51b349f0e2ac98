"""Sharding by balanced label propagation: equal texts are drawn into one shard while every shard
keeps its row quota (law ``rows``: shard counts differ by at most one).

Links: documents with equal texts, held as a star around their group (never as pairs).  Only a group
larger than a shard is split, as quotas must cut it: into blocks of a whole shard and a rest.  Blocks
above a quarter of a shard (fewer than four a shard, whatever the input) get their labels first, the
largest first, each the fullest shard that still takes it whole.  Every other linked document starts
in a shard drawn by hash from the room that is left.  Then, in rounds over these blocks:

1. each block counts its documents by shard (the join of documents and their block, aggregated);
2. a divided block wants the shard that holds most of it (ties by hash); one that was refused in
   the round before wants a shard drawn in proportion to the room that is left;
3. wishes are ranked within their shard, larger blocks first, and granted while the shard's quota,
   counting what wants to leave it, lasts (running totals over range partitions);
4. granted blocks move and the loads are updated - until no block is divided or the rounds end.

What a shard then holds beyond its quota (its smallest blocks) goes to shards with room, so quotas
hold exactly.  Unlinked documents cut no edge wherever they go and fill the room left, in order.

Cases: null text is the empty text (size 16); repeated rows are linked like equal texts; a null
doc_id is sharded like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrisk.llm.common import id_text, number_rows, places, running_total, stage

SHARDS = 40
ROUNDS = 8
ROW_OVERHEAD = 16  # bytes of a row besides its text


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: as many as the others or one more."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def loads(blocks: DataFrame, shards: int, count: str = "n") -> list[int]:
    """Documents by shard (one row per shard reaches the driver)."""
    found = {r["shard"]: r["total"] for r in blocks.groupBy("shard").agg(F.sum(count).alias("total")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard.cast("int") + 1)


def _edges(room: list[int]) -> list[int]:
    out = [0]
    for r in room:
        out.append(out[-1] + r)
    return out


def place_large(blocks: list[tuple[str, int]], sizes: list[int]) -> list[tuple[str, int, int]]:
    """(block, shard, n) for blocks (block, n): the largest first, each in the shard with the least
    room that holds it; one that fits nowhere is cut into as few parts as the room allows."""
    room, out = list(sizes), []
    for block, n in sorted(blocks, key=lambda x: (-x[1], x[0])):
        while n:
            fits = [s for s, r in enumerate(room) if r >= n]
            s = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            part = min(n, room[s])
            room[s] -= part
            n -= part
            out.append((block, s, part))
    return out


def label_propagation(blocks: DataFrame, sizes: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``blocks``: (block, shard, n), the documents of each block by shard.  Returns the same columns
    after at most ``rounds`` rounds; quotas are those of ``sizes``."""
    k, refused = len(sizes), None
    for step in range(rounds):
        per_block = blocks.groupBy("block").agg(
            F.sum("n").alias("total"),
            F.max(F.struct("n", F.xxhash64("block", "shard").alias("tie"), "shard")).alias("top"),
            F.count(F.lit(1)).alias("parts"),
        )
        wishes = per_block.filter("parts > 1").select("block", "total", F.col("top.shard").alias("want"))
        load = loads(blocks, k)
        if refused is not None:
            room = [max(0, sizes[s] - load[s]) for s in range(k)]
            if sum(room):
                at = F.pmod(F.xxhash64("block", F.lit(step)), F.lit(sum(room)))
                drawn = F.size(F.filter(F.array(*[F.lit(e) for e in _edges(room)[1:]]), lambda e: e <= at))
                wishes = wishes.join(refused.withColumn("_no", F.lit(True)), "block", "left").select(
                    "block", "total", F.when(F.col("_no"), drawn).otherwise(F.col("want")).alias("want")
                )
        held = blocks.select("block", F.col("shard").alias("want"), F.col("n").alias("held"))
        wishes = wishes.join(held, ["block", "want"], "left").select("block", "total", "want", (F.col("total") - F.coalesce("held", F.lit(0))).alias("need"))
        wishes = stage(wishes, f"wishes-{step}")
        away = blocks.join(wishes.select("block", "want"), "block").filter("shard <> want")
        leaving = loads(away, k)
        room = [max(0, sizes[s] - load[s] + leaving[s]) for s in range(k)]
        ranked = running_total(wishes, "want", [F.col("total").desc(), F.col("block")], "need", f"ranked-{step}")
        granted = stage(ranked.select("block", "total", "want", (F.col("upto") <= _by_shard(room, F.col("want"))).alias("ok")), f"granted-{step}")
        asked, moved = granted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("ok").cast("int")), F.lit(0))).first()
        if not asked:
            break
        refused = granted.filter("NOT ok").select("block")
        gone = granted.filter("ok").select("block", F.col("want").cast("int").alias("shard"), F.col("total").alias("n"))
        blocks = stage(blocks.join(gone.select("block"), "block", "left_anti").select("block", "shard", "n").unionByName(gone), f"blocks-{step}")
        if asked == moved:
            break
    return blocks


def within_quotas(blocks: DataFrame, sizes: list[int]) -> DataFrame:
    """Move what shards hold beyond ``sizes`` - their smallest blocks - to shards with room."""
    load = loads(blocks, len(sizes))
    if all(n <= q for n, q in zip(load, sizes)):
        return blocks
    ranked = running_total(blocks, "shard", [F.col("n").desc(), F.col("block")], "n", "quota-ranks")
    over = F.greatest(F.lit(0), F.least(F.col("n"), F.col("upto") - _by_shard(sizes, F.col("shard"))))
    split = stage(ranked.select("block", "shard", "n", over.cast("long").alias("x")), "quota-split")
    excess = running_total(split.filter("x > 0").select("block", "x", F.lit(0).alias("all")), "all", ["block"], "x", "excess")
    edges = _edges([max(0, q - n) for n, q in zip(load, sizes)])
    spans = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(edges[s]).cast("long").alias("lo"), F.lit(edges[s + 1]).cast("long").alias("hi")) for s in range(len(sizes))])
    moved = (
        excess.select("block", (F.col("upto") - F.col("x")).alias("a"), F.col("upto").alias("b"), F.explode(spans).alias("s"))
        .select("block", "s.shard", (F.least("b", "s.hi") - F.greatest("a", "s.lo")).alias("n"))
        .filter("n > 0")
    )
    kept = split.select("block", "shard", (F.col("n") - F.col("x")).alias("n")).filter("n > 0")
    return stage(kept.unionByName(moved).groupBy("block", "shard").agg(F.sum("n").alias("n")), "within-quotas")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), group_size and
    block (null for unlinked documents), one row per document."""
    one = id_text(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text").cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("grp"),
    )
    # range sorting reads its input twice: hash the texts once
    rows = stage(places(stage(one, "hashed"), "grp", [F.col("doc_id")], "nth", "grouped", "group_size"), "linked")
    total = rows.count()
    sizes = quotas(total, shards)
    block_rows = max(1, total // shards)
    whole = F.col("group_size") <= max(sizes)
    nth_block = F.when(whole, F.lit(0)).otherwise(F.floor(F.col("nth") / block_rows))
    linked = rows.filter("group_size > 1").select(
        "doc_id", "size", "text_crc32", "group_size",
        F.concat_ws(":", "grp", nth_block.cast("string")).alias("block"),
        F.when(whole, F.col("nth")).otherwise(F.col("nth") % block_rows).alias("at"),
        F.when(whole, F.col("group_size")).otherwise(F.least(F.lit(block_rows), F.col("group_size") - nth_block * block_rows)).alias("block_size"),
    )
    is_large = F.col("block_size") > block_rows // 4
    # fewer than four blocks a shard reach the driver
    large = place_large([(r["block"], r["block_size"]) for r in linked.filter(is_large & (F.col("at") == 0)).select("block", "block_size").collect()], sizes)
    left = list(sizes)
    for _, s, n in large:
        left[s] -= n
    at = F.pmod(F.xxhash64("block", "at"), F.lit(max(1, sum(left))))
    start = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in _edges(left)[1:]]), lambda e: e <= at))
    small = linked.filter(~is_large)
    blocks = stage(small.groupBy("block", start.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "start")
    blocks = within_quotas(label_propagation(blocks, left, rounds), left).select("block", F.col("shard").cast("int").alias("shard"), "n")
    fixed = rows.sparkSession.createDataFrame(large, "block string, shard int, n long")
    # a block's documents go to its shards in order of their place
    earlier = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per shard
    with_spans = lambda x: x.withColumn("lo", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # the rows of a large block stay where they are: its few spans go to them
    both = small.join(with_spans(blocks), "block").unionByName(linked.filter(is_large).join(F.broadcast(with_spans(fixed)), "block"))
    together = both.filter("at >= lo AND at < lo + n").select("doc_id", "size", "text_crc32", "group_size", "block", "shard")
    edges = _edges([q - n for n, q in zip(loads(blocks, shards), left)])
    single = number_rows(rows.filter("group_size = 1"), [F.col("doc_id"), F.col("grp")], "singles", "_g")
    fill = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges[1:]]), lambda e: e <= F.col("_g")))
    placed = together.unionByName(single.select("doc_id", "size", "text_crc32", "group_size", F.lit(None).cast("string").alias("block"), fill.alias("shard")))
    return places(placed, "shard", [F.col("doc_id"), F.col("text_crc32")], "slot", "slots").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size", "block"
    )
