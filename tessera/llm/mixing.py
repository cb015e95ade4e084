"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

Sources, in code-point order with null last, weigh 3, 1, 2, repeating, and share BUDGET times all
sizes; a target stops at CAP times its source's size and the excess is shared again by weight
until none is above. Targets are cut into blocks of BLOCK words: the highest quotients
target / (2j + 1) get them, first over sources, then over the shards of each source by shard
size. In a shard the documents stand in seeded order and their words are cut into blocks; a quota
takes whole passes over the blocks and then those that come first under a seeded permutation of
block numbers, which is computed where a document's own blocks are, without a sort or shuffle.

A shard is a hash class of documents, so a hot source is dealt out over as many shards as the rows
need. mix() shuffles only sizes; mixed_texts() sends each row once to its shard. What is broadcast or
ranked alone has one row a source or a few a shard. Rows of equal ids and sizes stand in order of a hash of
their texts, so reruns agree.

Defined results: null or blank texts have size 0 and take 0; a source of size 0 has target 0; an
empty table gives no rows. Repeated rows are documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settled

BLOCK, SEED, SHARD_ROWS = 32, 20240229, 4096
#: Beyond any count of blocks a shard can have, so that multiplying by it permutes block numbers.
PRIME = 1000000007
BUDGET, CAP, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, tie): words a document, 0 for null; tie: a hash of the text; keep: columns to carry along."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD + "+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n.alias("size"), F.xxhash64(text_col).alias("tie"), *(keep or []))


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water-filling in closed form: sources stop at their cap in the order of cap per weight, so the
    level is the least at which what is left over, shared by the weights left, stays under the next.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*map(F.lit, weights))
    rated = by_source.select("source", "source_size", F.element_at(table, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).alias("weight"))
    rated = rated.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("weight"))
    fill = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = rated.withColumn("used", F.sum("most").over(fill) - F.col("most")).withColumn("free", F.sum("weight").over(every) - F.sum("weight").over(fill) + F.col("weight")).withColumn("total", F.sum("source_size").over(every) * F.lit(budget))
    filled = filled.withColumn("share", (F.col("total") - F.col("used")) / F.col("free"))
    filled = filled.withColumn("stop", F.max(F.when(F.col("share") <= F.col("level"), F.col("share"))).over(every))
    return filled.select("source", "source_size", F.least("most", F.coalesce(F.col("stop") * F.col("weight"), F.col("most"))).alias("target"))


def apportion(votes: DataFrame, within: list[str], seats: str, vote: str, order: list[str]) -> DataFrame:
    """votes with a column quota: Sainte-Laguë over the rows of each group of within.

    A row's seats differ from its rounded proportional share by no more than the roundings of its
    group can move it, so only quotients near that share are ranked: the rest are sure.
    """
    group = Window.partitionBy(*within)
    total, rows, own = F.sum(vote).over(group), F.count("*").over(group), F.col(vote)
    share = F.when(total > 0, own / total).otherwise(F.lit(0.0))
    v = votes.withColumn("_share", share).withColumn("_rows", rows)
    reach = F.ceil(F.col("_share") * F.col("_rows") * 2 + 2)
    v = v.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share") * F.col(seats)) - reach).cast("long")).withColumn("_reach", (reach * 2 + 1).cast("long"))
    v = v.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    tried = v.filter(own > 0).select(*within, *order, vote, "_sure", "_left", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + F.col("_reach"))).alias("_j"))
    ranked = tried.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy((F.col(vote) / (F.col("_j") * 2 + 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], "_j"))).filter("_r <= _left")
    won = ranked.groupBy(*within, *order).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys([*within, *order]))
    on = None
    w = won.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_won")
    for i, k in enumerate(keys):
        c = v[k].eqNullSafe(w[f"_k{i}"])
        on = c if on is None else on & c
    joined = v.join(w, on, "left")
    return joined.select(*votes.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, **columns: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every document."""
    return _placed(docs, False, block, seed, weights, budget, cap, **columns)


def mixed_texts(docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of docs: a document's text once for each whole pass, and once more with the words of its other blocks taken."""
    base = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    j = _placed(base, True, block, seed, weights, budget, cap)
    text = F.col("_row")[text_col]
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.filter(found, lambda w, i: (F.pmod(F.pmod(F.floor((F.col("start") + i) / block).cast("long"), F.col("_count")) * F.lit(PRIME) + F.col("_shift"), F.col("_count")) < F.col("_rest"))), " ")
    rest = F.col("taken") - F.col("size") * F.col("_passes")
    texts = F.concat(F.array_repeat(text, F.col("_passes").cast("int")), F.when(rest > 0, F.array(F.when(rest == F.col("size"), text).otherwise(part))).otherwise(F.array().cast("array<string>")))
    out = j.filter("taken > 0").select("_row", F.explode(texts).alias("_text"))
    made = {text_col: F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*(made[c].alias(c) if c in made else F.col("_row")[c].alias(c) for c in docs.columns))


def _placed(docs: DataFrame, whole_rows: bool, block: int, seed: int, weights: tuple[float, ...], budget: float, cap: float, **columns: str) -> DataFrame:
    sized = settled(sizes(docs, **columns))
    whole = sized.agg(F.count("*").alias("n")).first()["n"]
    shards = max(1, math.ceil(whole / SHARD_ROWS))
    mark = F.xxhash64("doc_id", F.lit(seed))
    source = sizes(docs, keep=["_row"]) if whole_rows else sized
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed + 1)), F.lit(shards)))
    per_shard = settled(sharded.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")))
    per_source = targets(per_shard.groupBy("source").agg(F.sum("shard_size").alias("source_size")), weights, budget, cap)
    one = F.lit(1).alias("all")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = per_source.select("*", one, F.round(F.sum("target").over(every) / block).cast("long").alias("blocks"))
    quotas = settled(apportion(wanted, ["all"], "blocks", "target", ["source"]).select("source", "source_size", "target", F.col("quota").alias("source_quota")))
    q = quotas.select(F.col("source").alias("_s"), "source_size", "target", "source_quota")
    shard_votes = per_shard.join(q, per_shard["source"].eqNullSafe(q["_s"])).drop("_s")
    per_shard = settled(apportion(shard_votes, ["source"], "source_quota", "shard_size", ["shard"]))

    place = Window.partitionBy("source", "shard").orderBy(mark, "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    sharded = source.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed + 1)), F.lit(shards)))
    placed = sharded.withColumn("start", F.coalesce(F.sum("size").over(place), F.lit(0)))
    s = per_shard.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "source_size", "target", "quota")
    j = placed.join(s, placed["source"].eqNullSafe(s["_s"]) & (placed["shard"] == s["_h"]))
    size, start = F.col("size"), F.col("start")
    count = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)).cast("long")
    quota = F.least(F.col("quota"), F.floor(count * cap).cast("long"))
    j = j.withColumn("_count", count).withColumn("_passes", F.floor(quota / count).cast("long")).withColumn("_rest", quota % count)
    j = j.withColumn("_shift", F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.col("_count")))
    # block numbers times a prime beyond any count of blocks, plus a seeded shift: a permutation
    spun = lambda b: F.pmod(F.pmod(b, F.col("_count")) * F.lit(PRIME) + F.col("_shift"), F.col("_count"))
    overlap = lambda b: F.least(start + size, (b + 1) * block) - F.greatest(start, b * block)
    first, last = F.floor(start / block).cast("long"), F.floor((start + size - 1) / block).cast("long")
    some = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, b: a + F.when(spun(b) < F.col("_rest"), overlap(b)).otherwise(F.lit(0)))
    taken = F.when(size > 0, size * F.col("_passes") + some).otherwise(F.lit(0)).cast("long")
    j = j.withColumn("taken", taken)
    return j if whole_rows else j.select("doc_id", "size", "source_size", "target", "taken", "source")
