"""Items of varying length into containers of fixed capacity: vector bin packing by dot products.

Each item has a vector (tokens, one segment, loss-bearing tokens), each container a vector of
limits. A container is filled by taking again and again the item, among those that fit in every
dimension, whose vector has the largest product with what room is left, weighted by how scarce each
dimension is. Items longer than the capacity are cut into full pieces and a rest; no other is cut.

Items are spread by hash over blocks of about ``block`` items, packed independently, so no task
grows with the data; a block leaves one container partly filled. With ``block`` None all items are one block, the exact
heuristic. Loss-bearing are all tokens but the first of a document, as nothing predicts it; instruction data name their
own column, and give the limits on segments and on loss-bearing tokens as shares of the capacity.

Edge cases: items without tokens take no room and are left out; null capacities are skipped; ties
go to the smaller key; the same input gives the same containers.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 8192
#: tokens of capacity per segment that a container may hold
TOKENS_A_SEGMENT = 4
_PLACED = "container_kind string, block int, container_no int, key {kind}, piece_no int, n_tokens int, loss_tokens int"


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """The container number of each item; limits: tokens, segments, loss-bearing tokens."""
    classes: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(len(tokens) - 1, -1, -1):
        classes[(int(tokens[i]), int(loss[i]))].append(i)
    vectors = np.array(sorted(classes), dtype=np.float64).reshape(-1, 2)
    items = [classes[tuple(map(int, v))] for v in vectors]
    alive = np.ones(len(items), dtype=bool)
    left_t, left_l = float(tokens.sum()), float(loss.sum())
    where = np.full(len(tokens), -1, dtype=np.int64)
    cap_t, cap_s, cap_l = limits
    n, placed = 0, 0
    while placed < len(tokens):
        t, s, ll = cap_t, cap_s, cap_l
        scarce_t, scarce_l = left_t / cap_t, left_l / max(1, cap_l)
        weight = np.array([scarce_t / cap_t**2, scarce_l / max(1, cap_l) ** 2])
        while s > 0:
            top = int(np.searchsorted(vectors[:, 0], t, side="right"))
            ok = alive[:top] & (vectors[:top, 1] <= ll)
            if not ok.any():
                break
            score = np.where(ok, vectors[:top, 0] * (weight[0] * t) + vectors[:top, 1] * (weight[1] * ll), -1.0)
            k = top - 1 - int(np.argmax(score[::-1]))
            i = items[k].pop()
            if not items[k]:
                alive[k] = False
            where[i] = n
            placed += 1
            t, s, ll = t - int(tokens[i]), s - 1, ll - int(loss[i])
            left_t, left_l = left_t - tokens[i], left_l - loss[i]
        n += 1
    return where


def limits_of(capacity: int, tokens_a_segment: float = TOKENS_A_SEGMENT, loss_share: float = 1.0) -> tuple[int, int, int]:
    """Tokens, segments and loss-bearing tokens that a container may hold; a piece that fills it always fits."""
    return capacity, max(1, int(capacity / tokens_a_segment)), max(1, int(capacity * loss_share))


def placed(
    sized: DataFrame, containers: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", loss: str | None = None, block: int | None = BLOCK, tokens_a_segment: float = TOKENS_A_SEGMENT, loss_share: float = 1.0
) -> DataFrame:
    """(container_kind, block, container_no, key, piece_no, n_tokens, loss_tokens): each item's place in a container of each kind.

    An item with more tokens, or more loss-bearing ones, than a container may hold is cut into as few equal-limit pieces as needed.
    """
    kind = dict(sized.dtypes)[key]
    borne = F.col(loss) if loss else F.col(tokens) - 1
    items = sized.where(F.col(key).isNotNull() & (F.col(tokens) > 0)).select(F.col(key).alias("key"), F.col(tokens).cast("int").alias("n"), F.least(borne, F.col(tokens)).cast("int").alias("loss"))
    kinds = containers.where("capacity_tokens > 0 AND container_kind IS NOT NULL").select("container_kind", F.col("capacity_tokens").alias("capacity")).distinct()
    blocks = max(1, math.ceil(sized.count() / block)) if block else 1
    # one row per item and kind of container, of which there are a few
    each = items.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).crossJoin(F.broadcast(kinds))
    most_loss = F.greatest(F.floor(F.col("capacity") * loss_share), F.lit(1))
    whole = (F.col("n") <= F.col("capacity")) & (F.col("loss") <= most_loss)
    # a full piece holds as many tokens as keep its share of the loss-bearing ones within the limit
    full = F.when(whole, F.col("n")).otherwise(F.greatest(F.lit(1), F.least(F.col("capacity"), F.floor(F.col("n") * most_loss / F.greatest("loss", F.lit(1)))))).cast("int")
    each = each.withColumn("full", full)
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("full")).cast("int") - 1)).alias("piece_no")
    cut = each.select("container_kind", "capacity", "block", "key", "n", "loss", "full", piece)
    upto = lambda k: F.floor(F.col("loss") * F.least(F.col("n"), k * F.col("full")) / F.col("n"))
    size = F.least(F.col("full"), F.col("n") - F.col("piece_no") * F.col("full"))
    borne = F.least(size, most_loss, upto(F.col("piece_no") + 1) - upto(F.col("piece_no")))
    cut = cut.select("container_kind", "capacity", "block", "key", "piece_no", size.cast("int").alias("n_tokens"), borne.cast("int").alias("loss_tokens"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "piece_no"], kind="stable")
        limits = limits_of(int(pdf["capacity"].iloc[0]), tokens_a_segment, loss_share)
        pdf["container_no"] = pack(pdf["n_tokens"].to_numpy(), pdf["loss_tokens"].to_numpy(), limits)
        return pdf[["container_kind", "block", "container_no", "key", "piece_no", "n_tokens", "loss_tokens"]]

    return cut.groupBy("container_kind", "block").applyInPandas(run, _PLACED.format(kind=kind)).withColumnRenamed("key", key)


def utilisation(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, n_containers, n_items, n_tokens, fill): how full the containers of each kind are."""
    used = placed.groupBy("container_kind").agg(F.countDistinct("block", "container_no").alias("n_containers"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    kinds = containers.select("container_kind", "capacity_tokens").distinct()
    return used.join(F.broadcast(kinds), "container_kind").select("container_kind", "n_containers", "n_items", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"))


def audit(placed: DataFrame, sized: DataFrame, containers: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", tokens_a_segment: float = TOKENS_A_SEGMENT, loss_share: float = 1.0) -> DataFrame:
    """(container_kind, n_items, n_missing, n_wrong_size, n_cut_in_vain, n_over): what is not as it should be, all 0 but the first.

    Items without a place, items whose pieces do not add up to them, items cut though they fit a container, and containers
    beyond a limit.
    """
    kinds = containers.where("capacity_tokens > 0 AND container_kind IS NOT NULL").select("container_kind", F.col("capacity_tokens").alias("capacity")).distinct()
    want = sized.where(F.col(key).isNotNull() & (F.col(tokens) > 0)).groupBy(key).agg(F.sum(tokens).alias("want"), F.count("*").alias("times")).crossJoin(F.broadcast(kinds))  # a few kinds
    got = placed.groupBy("container_kind", key).agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.sum("loss_tokens").alias("loss"))
    both = want.join(got, ["container_kind", key], "left")
    n = lambda c: F.count(F.when(c, 1))
    most = F.floor(F.col("capacity") * loss_share)
    items = both.groupBy("container_kind").agg(
        F.count("*").alias("n_items"), n(F.col("got").isNull()).alias("n_missing"), n(F.col("got") != F.col("want")).alias("n_wrong_size"),
        n((F.col("pieces") > F.col("times")) & (F.col("want") <= F.col("capacity")) & (F.col("loss") <= most)).alias("n_cut_in_vain"),
    )
    full = placed.groupBy("container_kind", "block", "container_no").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l")).join(F.broadcast(kinds), "container_kind")
    over = (F.col("t") > F.col("capacity")) | (F.col("s") > F.greatest(F.lit(1), F.floor(F.col("capacity") / tokens_a_segment))) | (F.col("l") > F.greatest(F.lit(1), most))
    out = items.join(full.groupBy("container_kind").agg(n(over).alias("n_over")), "container_kind", "left")
    return out.select("container_kind", "n_items", "n_missing", "n_wrong_size", "n_cut_in_vain", F.coalesce("n_over", F.lit(0)).alias("n_over"))
