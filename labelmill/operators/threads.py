"""Reply structure of comment threads and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.session import durable

BLOCK = 65_536


def previous_in_group(df: DataFrame, group: str, order: str, block: int = BLOCK) -> DataFrame:
    """Adds `previous`, `rank` (from 0) and `first` of each row within its group.

    `order` holds non-negative integers, unique in the group. A window over a whole group would put
    one huge conversation into one task. Rows are therefore ranked in blocks of at most `block` order
    values, and the few rows that summarise blocks carry last value, size and start from block to
    block - again in blocks, so no task ever holds more than `block` rows of one group until a group
    has more than block**3 of them. Ordinary groups fit one block and need no summary rows.
    """
    inside = Window.partitionBy(group, "_block").orderBy(order)
    blocked = df.withColumn("_block", F.expr(f"`{order}` div {block}"))
    upper_block = F.expr(f"_block div {block}")
    ranked = blocked.withColumns({
        "_prev": F.lag(order).over(inside),
        "_rank": F.row_number().over(inside) - 1,
    })
    blocks = blocked.groupBy(group, "_block").agg(
        F.max(order).alias("_last"), F.min(order).alias("_start"), F.count("*").alias("_size"))
    supers = blocks.withColumn("_super", upper_block).groupBy(group, "_super").agg(
        F.max("_last").alias("_last"), F.min("_start").alias("_start"), F.sum("_size").alias("_size"))

    def carried(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
        over = Window.partitionBy(*keys).orderBy(at)
        before = over.rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({
            "_carry_last": F.lag("_last").over(over),
            "_carry_size": F.coalesce(F.sum("_size").over(before), F.lit(0)),
            "_carry_start": F.min("_start").over(before),
        })

    upper = carried(supers, [group], "_super").filter(F.col("_super") > 0).select(
        group, "_super", F.col("_carry_last").alias("_u_last"), F.col("_carry_size").alias("_u_size"),
        F.col("_carry_start").alias("_u_start"))
    lower = carried(
        blocks.withColumn("_super", upper_block), [group, "_super"], "_block"
    ).filter(F.col("_block") > 0).join(upper, [group, "_super"], "left").select(
        group, "_block",
        F.coalesce("_carry_last", "_u_last").alias("_b_last"),
        (F.col("_carry_size") + F.coalesce("_u_size", F.lit(0))).alias("_b_size"),
        F.least("_carry_start", "_u_start").alias("_b_start"))
    start = F.min(order).over(Window.partitionBy(group, "_block"))
    return (
        ranked.withColumn("_start", start).join(lower, [group, "_block"], "left")
        .withColumns({
            "previous": F.coalesce("_prev", "_b_last"),
            "rank": (F.col("_rank") + F.coalesce("_b_size", F.lit(0))).cast("bigint"),
            "first": F.least("_start", "_b_start"),
        })
        .select(*df.columns, "previous", "rank", "first")
    )


def _salted_join(left: DataFrame, right: DataFrame, key: str, row_id: str, share: int = 1000,
                 salts: int = 64) -> DataFrame:
    """Left join on a key that is unique in `right` and may be heavily repeated in `left`.

    Keys that hold more than 1/share of the left rows number fewer than `share`, so their list may be
    broadcast. Their left rows are spread over `salts` buckets and their right rows, at most
    share x salts of them, are copied to each bucket. Rows without a key match nothing and are spread
    as well. All other keys stay in bucket 0.
    """
    total = left.agg(F.count("*").alias("n"))
    heavy = F.broadcast(
        left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        .filter(F.col("_n") * share > total.scalar())
        .select(key, F.lit(True).alias("_heavy")))
    first, last = F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")
    buckets = F.when(F.col("_heavy"), F.sequence(first, last)).otherwise(F.array(first))
    spread = left.join(heavy, key, "left").withColumn(
        "_salt", F.when(F.col("_heavy") | F.col(key).isNull(), F.pmod(F.xxhash64(row_id), F.lit(salts)))
        .otherwise(first)).drop("_heavy")
    copied = right.join(heavy, key, "left").withColumn(
        "_salt", F.explode(buckets)).drop("_heavy")
    return spread.join(copied, [key, "_salt"], "left").drop("_salt")


def _inside(comment: str, within: str | None) -> Column:
    """Key of a comment: its id, or its id in its work. Ids may repeat from work to work."""
    return F.col(comment) if within is None else F.when(F.col(comment).isNotNull(), F.struct(within, comment))


def _follow(steps: DataFrame, rounds: int) -> DataFrame:
    """(node, target, hops): `steps` followed until the target has no step of its own.

    Each round doubles the distance covered, so a chain of n steps takes about log2(n) rounds. Every
    round is written to the checkpoint folder.
    """
    steps = durable(steps)
    for _ in range(rounds):
        hop = steps.select(F.col("node").alias("target"), F.col("target").alias("_next"),
                           F.col("hops").alias("_hops"), F.lit(True).alias("_hit"))
        stepped = _salted_join(steps, hop, "target", "node")
        if stepped.filter(F.col("_hit") & F.col("_next").isNotNull()).limit(1).count() == 0:
            return durable(stepped.select(
                "node", F.when(F.col("_hit"), F.col("_next")).otherwise(F.col("target")).alias("target"),
                (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")))
        steps = durable(stepped.select(
            "node", F.when(F.col("_hit"), F.col("_next")).otherwise(F.col("target")).alias("target"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")))
    raise ValueError("comments form a cycle")


def reattach(comments: DataFrame, rounds: int = 64, within: str | None = None) -> DataFrame:
    """Live comments, replies to a deleted comment moved to its nearest live ancestor.

    Expects `comment_id`, `parent_comment`, `deleted`, and the column that `within` names, such as the
    work, if ids are unique only inside it. Only deleted comments are followed.
    """
    keyed = comments.withColumns({"_id": _inside("comment_id", within), "_up": _parent(within)})
    gone = keyed.filter("deleted").select(F.col("_id").alias("node"), F.col("_up").alias("target"), F.lit(1).alias("hops"))
    moved = _follow(gone, rounds).select(
        F.col("node").alias("_up"), F.col("target").alias("_target"), F.lit(True).alias("_moved"))
    live = _salted_join(keyed.filter(~F.col("deleted")), moved, "_up", "_id")
    target = F.col("_target") if within is None else F.col("_target")["comment_id"]
    return live.withColumn(
        "parent_comment", F.when(F.col("_moved"), target).otherwise(F.col("parent_comment"))
    ).select(*comments.columns).drop("deleted")


def _parent(within: str | None) -> Column:
    if within is None:
        return F.col("parent_comment")
    return F.when(F.col("parent_comment").isNotNull(), F.struct(F.col(within), F.col("parent_comment").alias("comment_id")))


def trees(comments: DataFrame, rounds: int = 64, within: str | None = None) -> DataFrame:
    """Adds `root` and `depth` (0 for a root) to comments with `comment_id` and `parent_comment`.

    A comment whose parent is not among the rows is a root. No task ever holds a whole tree.
    """
    keyed = comments.withColumns({"_id": _inside("comment_id", within), "_up": _parent(within)})
    known = keyed.select(F.col("_id").alias("_up"), F.lit(True).alias("_known")).distinct()
    linked = _salted_join(keyed.select("_id", "_up"), known, "_up", "_id").select(
        F.col("_id").alias("node"), F.when(F.col("_known"), F.col("_up")).alias("target"),
        F.when(F.col("_known"), 1).otherwise(0).alias("hops"))
    # Roots point at themselves without a step, so that chains end there.
    top = linked.filter(F.col("target").isNull()).select("node", F.col("node").alias("_root"))
    found = _follow(linked.filter(F.col("target").isNotNull()), rounds)
    placed = found.select(F.col("node").alias("_id"), F.col("target").alias("_root"), "hops").unionByName(
        top.select(F.col("node").alias("_id"), "_root", F.lit(0).alias("hops")))
    root = F.col("_root") if within is None else F.col("_root")["comment_id"]
    return keyed.join(placed, "_id").select(*comments.columns, root.alias("root"), F.col("hops").alias("depth"))
