"""Mixing sources to target weights by pivotal rounding of copies, with residuals combined through a reduction tree."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebound.session import written

#: Documents that one task rounds at a time, how many nodes' residuals one task of the next round takes, and how many of a node's
#: shortest open documents go up with what it leaves open, so that the root can come near its sum.
CHUNK_DOCS, FAN_IN, KEPT = 5_000, 256, 32
_EPS = 1e-9


def pivotal(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions to 0 or 1, but for at most one. Each step takes two fractions and moves mass between them, in the one
    or the other direction at random, until one is integral; their weighted sum stays, and each keeps its expectation."""
    p = p.copy()
    open_at = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    p[p <= _EPS], p[p >= 1 - _EPS] = 0.0, 1.0
    if len(open_at) < 2:
        return p
    chance = rng.random(len(open_at))
    i, x, w = open_at[0], p[open_at[0]], weight[open_at[0]]
    for k in range(1, len(open_at)):
        j = open_at[k]
        y, v = p[j], weight[j]
        up, down = min((1 - x) * w, y * v), min(x * w, (1 - y) * v)
        if chance[k] * (up + down) < down:
            x, y = x + up / w, y - up / v
        else:
            x, y = x - down / w, y + down / v
        if _EPS < x < 1 - _EPS:
            p[j] = round(y)
            if _EPS < y < 1 - _EPS:  # both are open only by rounding error
                p[j] = float(y > 0.5)
        else:
            p[i] = float(x > 0.5)
            i, x, w = j, y, v
    p[i] = x if _EPS < x < 1 - _EPS else float(x > 0.5)
    return p


def settle(before: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Round what pivotal(before, ...) left open, so that the weighted sum is missed by little: the open fraction goes to its nearer end,
    and from the largest weight to the smallest, each fraction that was open before changes sides if the sum is nearer then."""
    p, lack = p.copy(), float((before * weight).sum() - (p * weight).sum())
    for i in np.flatnonzero((p > 0) & (p < 1)):
        lack += (p[i] - round(p[i])) * weight[i]
        p[i] = round(p[i])
    for i in np.argsort(-weight, kind="stable"):
        if _EPS < before[i] < 1 - _EPS:
            change = weight[i] * (1 - 2 * p[i])
            if abs(lack - change) < abs(lack):
                p[i], lack = 1 - p[i], lack - change
    return p


#: Rows of a plan (a row per mix and source) up to which it is broadcast.
PLAN_ROWS = 100_000


def _filled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The plan of one mix: what capped and empty sources cannot give is given by the others, in proportion to their targets, until
    the mix has its size or all sources are at their caps."""
    target, most = pdf["target_tokens"].to_numpy(float), pdf["most_tokens"].to_numpy(float)
    planned, open_at = np.minimum(target, most), (most > target) & (target > 0)
    while open_at.any() and target.sum() - planned.sum() > _EPS * target.sum():
        rest = target.sum() - planned[~open_at].sum()
        scaled = target[open_at] * (rest / target[open_at].sum())
        planned[open_at] = np.minimum(scaled, most[open_at])
        full = open_at & (planned >= most)
        if not full.any():
            break
        open_at &= ~full
    return pdf.assign(planned_tokens=planned)


def mix_plan(sizes: DataFrame, targets: DataFrame, fill: bool = True) -> DataFrame:
    """targets' rows with source_docs, source_tokens, target_tokens, planned_tokens and copies, the expected copies of each document.

    A mix has size_factor times the tokens of all rows of sizes; a source aims at target_share of that and is capped at
    max_repeats copies. With fill, what capped sources lack is planned for the others in proportion to their targets, so that the
    mix has its size if the caps allow it; without, each source is planned at its own target or cap and the mix is smaller. Sources
    without tokens have none. A NULL number in targets counts as 0.
    """
    sizes = sizes.select("source", "n_tokens")
    of_source = sizes.where("source IS NOT NULL AND n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("n_tokens").alias("source_tokens"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).scalar()
    wanted = targets.select("mix_id", "source", "target_share", "max_repeats", "size_factor").join(of_source, "source", "left").fillna(0, ["source_docs", "source_tokens"])
    wanted = wanted.withColumn("target_tokens", F.greatest(F.lit(0.0), F.coalesce(F.col("target_share") * F.col("size_factor"), F.lit(0.0))) * total)
    most = F.greatest(F.lit(0), F.coalesce(F.col("max_repeats"), F.lit(0))) * F.col("source_tokens").cast("double")
    wanted = wanted.withColumn("most_tokens", most).withColumn("planned_tokens", F.least("target_tokens", "most_tokens"))
    if fill:  # a group is one mix of the parameters
        wanted = wanted.groupBy("mix_id").applyInPandas(_filled, wanted.schema)
    return wanted.withColumn("copies", F.when(F.col("source_tokens") > 0, F.col("planned_tokens") / F.col("source_tokens")).otherwise(0.0))


def draw_mix(sizes: DataFrame, targets: DataFrame, seed: int = 0, fill: bool = True) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, copies) of each document that a mix uses, copies >= 1.

    sizes has doc_id, source and n_tokens; rows with a NULL source or no tokens are never drawn. targets is a small table of
    parameters (a row per mix and source); see mix_plan for fill. A document's copies are its expected copies rounded down or up.
    Documents are rounded in chunks, and what a chunk leaves open goes up a reduction tree with its shortest documents. At the root the last fraction is rounded
    and documents that were open there change sides where that brings the source nearer to its plan, so that it misses it by about
    its shortest open document; that last step is not random. The draw depends only on seed and the data, so a task that runs again
    gives the same. Rows with a NULL doc_id are documents like others.
    """
    plan = written(mix_plan(sizes, targets, fill).where("copies > 0"), "plan")
    most, n_plan = plan.agg(F.max("source_docs"), F.count(F.lit(1))).first()
    chunks = max(1, math.ceil((most or 0) / CHUNK_DOCS))
    lean = plan.select("mix_id", "source", "source_docs", "copies")
    drawn = sizes.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(F.broadcast(lean) if n_plan <= PLAN_ROWS else lean, "source")
    own = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / CHUNK_DOCS))
    state = drawn.select(
        "mix_id", "source", "doc_id", "n_tokens", F.floor("copies").cast("bigint").alias("base"),
        (F.col("copies") - F.floor("copies")).alias("p"),
        F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(seed)), own).cast("bigint").alias("node"),
    )
    sure = state.where((F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS))
    open_rows, level, parts = state.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)), 0, [sure]
    while True:
        rounded = written(_round(open_rows, seed, level, chunks == 1), "rounded")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        parts.append(rounded.where(settled))
        if chunks == 1:
            break
        chunks, level = math.ceil(chunks / FAN_IN), level + 1
        open_rows = rounded.where(~settled).withColumn("node", F.floor(F.col("node") / FAN_IN))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    copies = (F.col("base") + F.round("p").cast("bigint")).alias("copies")
    return whole.select("mix_id", "source", "doc_id", "n_tokens", copies).where("copies > 0")


def _round(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Pivotal rounding within each node, from the longest document to the shortest; at the root (last) nothing stays open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        first = pdf.iloc[0]
        key = f"{seed}|{level}|{first['mix_id']}|{first['source']}|{first['node']}"
        rng = np.random.default_rng(zlib.crc32(key.encode()))
        before, weight = pdf["p"].to_numpy(float), pdf["n_tokens"].to_numpy(float)
        if last:
            return pdf.assign(p=settle(before, pivotal(before, weight, rng), weight))
        rounded = max(0, len(pdf) - KEPT)
        return pdf.assign(p=np.append(pivotal(before[:rounded], weight[:rounded], rng), before[rounded:]))

    return rows.groupBy("mix_id", "source", "node").applyInPandas(run, rows.schema)


def mix_report(sizes: DataFrame, targets: DataFrame, drawn: DataFrame, fill: bool = True) -> DataFrame:
    """Per mix and source of targets: the target, the plan, what was drawn, the share of the mix really reached, whether repeats are capped
    (the source cannot give its target). fill as the mix was drawn."""
    of_source = drawn.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("used_docs"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"))
    of_mix = of_source.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("mix_tokens"))
    joined = mix_plan(sizes, targets, fill).join(of_source, ["mix_id", "source"], "left").join(of_mix, "mix_id", "left")
    return joined.select(
        "mix_id", "source", "target_share", "max_repeats", "source_docs", "source_tokens", "target_tokens", "planned_tokens",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("used_docs", "most_copies", "drawn_tokens")],
        F.coalesce(F.col("drawn_tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"),
        (F.col("target_tokens") > F.col("most_tokens")).alias("is_capped"),
    )
