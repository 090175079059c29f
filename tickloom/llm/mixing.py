"""Mixing sources to target weights.

Sources, ordered by code point with null last, weigh 1, 2, 3, repeating, and share all words by weight; a
target stops at ``most`` times its source's size and the excess is shared anew by weight. Documents fall
into hashed blocks. A source's quota is a number of whole passes over its blocks and a permuted draw of
blocks for what remains. Quotas of all sources are split among output shards by a binary tree: every node
draws its left half from the multivariate hypergeometric distribution, so shards are equally large and
mixed at random, yet every quota is met exactly. Permuted block copies then go to shards in disjoint runs
and documents are shuffled inside their shard.

Nothing larger than a source's blocks (``blocks`` rows, summed before) or one row per source meets in a
task, whatever a source's size. Null texts have size 0; a null source is a source of its own; ids may be
null or repeated (equal rows are drawn together); an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.words import PATTERN
from tickloom.session import checkpoint

MOST = 3
BLOCKS = 1024
SHARDS = 64
SEED = 20_011


def sized(docs: DataFrame, *keep: str | Column, text: str = "text", source: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """The columns ``keep`` with the source's key, the size in words and the block."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(PATTERN)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    own = F.xxhash64(F.lit(SEED), *[F.col(c) if isinstance(c, str) else c for c in keep], F.xxhash64(text))
    return docs.select(*keep, key.alias("_key"), size.alias("size"), F.pmod(own, F.lit(blocks)).cast("int").alias("_block"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(_key, source_size, weight, target) from (_key, source_size); one row per source meets here.

    In ascending order of ``most * size / weight`` a source is at its limit if the share of what the ones
    before leave would exceed it; the first one that isn't fixes the share per weight of all the rest.
    """
    by_name = Window.orderBy(F.col("_key") == "", "_key")
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    limit = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), "_key")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = weighed.withColumn("_share", left / heavy)
    free = share.withColumn("_free", F.col("_share") * F.col("weight") <= limit)
    rate = free.withColumn("_rate", F.first(F.when(F.col("_free"), F.col("_share")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_free"), F.col("_rate") * F.col("weight")).otherwise(limit)
    return rate.select("_key", "source_size", "weight", target.alias("target"))


def _rng(*parts: object) -> np.random.Generator:
    return np.random.default_rng([SEED, *[p if isinstance(p, int) else xxhash.xxh3_64_intdigest(str(p)) for p in parts]])


def draw_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Copies of each block of one source: whole passes, then permuted blocks that fit what remains."""
    key, size, target = group["_key"].iloc[0], int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    group = group.sort_values("_block").reset_index(drop=True)
    order = _rng("blocks", key).permutation(len(group))
    passes = int(target // size) if size else 0
    rest = target - passes * size
    words, extra = group["words"].to_numpy(), np.zeros(len(group), np.int64)
    for i in order:
        if words[i] <= rest:
            extra[i], rest = 1, rest - words[i]
    # one block more, or one for another, if that comes nearer
    out, taken = np.flatnonzero(extra == 0), np.flatnonzero(extra)
    if rest > 0 and len(out):
        taken = taken[np.argsort(words[taken], kind="stable")]
        sizes = np.concatenate([[0], words[taken]])
        near = np.clip(np.searchsorted(sizes, words[out] - rest), 1, len(sizes) - 1) if len(taken) else np.zeros(len(out), np.int64)
        options = [(abs(rest - words[j] + sizes[k]), int(j), int(k)) for j, c in zip(out, near) for k in {0, c, max(c - 1, 0)}]
        error, j, k = min(options)
        if error < rest:
            extra[j] = 1
            if k:
                extra[taken[k - 1]] = 0
    place = np.empty(len(group), np.int64)
    place[order] = np.arange(len(group))
    return pd.DataFrame({"_key": key, "_block": group["_block"], "copies": passes + extra, "_place": place})


def split_quotas(quotas: pd.DataFrame, shards: int = SHARDS) -> pd.DataFrame:
    """(_key, shard, quota) of the tree's leaves from (_key, quota): one row per source."""
    quotas = quotas.sort_values("_key").reset_index(drop=True)
    level = [quotas["quota"].to_numpy(np.int64)]
    while len(level) < shards:
        halves = []
        for i, node in enumerate(level):
            total = int(node.sum())
            left = _rng("tree", len(level), i).multivariate_hypergeometric(node, total // 2, method="marginals") if len(node) else node
            halves += [left, node - left]
        level = halves
    return pd.DataFrame({"_key": np.tile(quotas["_key"], len(level)), "shard": np.repeat(np.arange(len(level)), len(quotas)), "quota": np.concatenate(level)})


def assign(blocks: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
    """Shards of each block's copies: permuted copies fill the shards' quotas one after the other."""
    if blocks.empty:
        return pd.DataFrame({"_key": [], "_block": [], "copies": [], "shards": []})
    copies = blocks.loc[blocks.index.repeat(blocks["copies"]), ["_block", "_place"]].copy()
    copies["n"] = copies.groupby("_block").cumcount()
    copies = copies.sort_values(["n", "_place"])
    leaves = leaves.sort_values("shard")
    copies["shard"] = np.repeat(leaves["shard"].to_numpy(), leaves["quota"].to_numpy())
    shards = copies.groupby("_block")["shard"].agg(list)
    out = blocks[["_key", "_block", "copies"]].copy()
    out["shards"] = [shards.get(b, []) for b in blocks["_block"]]
    return out


def mix_plan(docs: DataFrame, *keep: str | Column, text: str = "text", source: str = "source", shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """Per row the columns ``keep``, size, source_size, target, copies, taken and the shards of its copies."""
    rows = checkpoint(sized(docs, *keep, text=text, source=source, blocks=blocks))
    by_block = rows.groupBy("_key", "_block").agg(F.sum("size").alias("words"))
    aims = targets(rows.groupBy("_key").agg(F.sum("size").alias("source_size")))
    drawn = checkpoint(
        by_block.join(aims, "_key").groupBy("_key").applyInPandas(draw_blocks, "_key string, _block int, copies long, _place long")
    )
    leaves = (
        drawn.groupBy("_key").agg(F.sum("copies").alias("quota")).groupBy(F.lit(0).alias("_all"))
        .applyInPandas(lambda q: split_quotas(q[["_key", "quota"]], shards), "_key string, shard int, quota long")
    )
    plan = drawn.groupBy("_key").cogroup(leaves.groupBy("_key")).applyInPandas(assign, "_key string, _block int, copies long, shards array<int>")
    names = [c for c in rows.columns if c not in ("_key", "size", "_block")]
    return rows.join(plan, ["_key", "_block"]).join(aims, "_key").select(
        *names, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "shards"
    )


def shuffled(docs: DataFrame, shards: int = SHARDS, **names: str) -> DataFrame:
    """The mix itself: each copy of each row in its shard, in an order drawn inside the shard."""
    plan = mix_plan(docs, F.struct(*docs.columns).alias("_row"), shards=shards, **names)
    copies = plan.select("_row", F.posexplode("shards").alias("_copy", "shard"))
    placed = copies.withColumn("_order", F.xxhash64(F.lit(SEED), "_copy", "_row"))
    return placed.repartition(shards, "shard").sortWithinPartitions("shard", "_order").select("_row.*", "shard")
