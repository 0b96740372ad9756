"""Exact selection by rank without sorting a whole group in one task.

A plain ``row_number()`` over a label, or ``orderBy().limit(n)`` with a large n, sends the
whole group through one task. Here a histogram over hash prefixes finds, per group, the one
hash at which the cut falls; every other row is then decided by a comparison on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEX_PER_STEP = 4  # 2**16 counts per step and group
_FETCH_AT_MOST = 65_536
_COPIES_PER_STEP = 10_000


def key_hash(seed: int, key: str) -> Column:
    """md5 of seed and key: the order in which rows are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _content_hash(names: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*names)))


def replicate(df: DataFrame, times: Column, index: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``index``.

    Rows are dealt over tasks by their content and long runs by steps as well, before they are
    multiplied: neither many rows with few copies nor one row with very many meet in one task.
    """
    step = _COPIES_PER_STEP
    return (
        df.withColumn("__times", times.cast("bigint"))
        .filter("__times > 0")
        .withColumn("__step", F.explode(F.expr(f"sequence(0L, (__times - 1) div {step})")))
        .repartition(F.xxhash64(*df.columns), "__step")
        .withColumn("__left", F.expr(f"least({step}L, __times - __step * {step})"))
        .withColumn(index, F.explode(F.expr(f"sequence(__step * {step} + 1, __step * {step} + __left)")))
        .drop("__times", "__step", "__left")
    )


def _narrow(hashed: DataFrame, quotas: dict) -> tuple[dict, dict]:
    """Per group: all or nothing, or (hash at the cut, rows wanted with it, rows there are).

    Each round returns to the driver at most 2**16 counts per group and fixes four more hex
    digits; once few rows share the prefix, their full hashes finish the search.
    """
    whole: dict = {g: False for g, quota in quotas.items() if quota <= 0}
    open_: dict = {g: ("", quota, None) for g, quota in quotas.items() if quota > 0}
    cuts: dict = {}
    while open_:
        width = {g: 32 if n is not None and n <= _FETCH_AT_MOST else min(32, len(p) + _HEX_PER_STEP)
                 for g, (p, _, n) in open_.items()}
        wanted_rows: Column | None = None
        prefix: Column | None = None
        for g, (p, _, _) in open_.items():
            here = F.col("__g").eqNullSafe(F.lit(g))
            mine = here & F.col("__hash").startswith(p) if p else here
            wanted_rows = mine if wanted_rows is None else wanted_rows | mine
            cut = F.substring("__hash", 1, width[g])
            prefix = F.when(here, cut) if prefix is None else prefix.when(here, cut)
        counts = hashed.filter(wanted_rows).groupBy("__g", prefix.alias("p")).count().collect()
        still: dict = {}
        for g, (_, quota, _) in open_.items():
            for p, n in sorted((r["p"], r["count"]) for r in counts if r["__g"] == g):
                if n > quota:
                    if quota == 0 or width[g] == 32:
                        cuts[g] = (p.ljust(32, "0"), quota, n)
                    else:
                        still[g] = (p, quota, n)
                    break
                quota -= n
            else:
                whole[g] = True
        open_ = still
    return whole, cuts


def draw(
    df: DataFrame, quotas: dict, *, group: str | None, flag: str, seed: int = 0, key: str | None = None
) -> DataFrame:
    """Mark in ``flag`` exactly ``quotas[g]`` rows of each group g, those with the smallest hash.

    Groups are a handful of known values (labels). Rows are ordered by the hash of ``key``;
    rows of one key at the cut are ordered by their content; full copies are counted and put
    out again in the wanted numbers. So no group, key or heap of copies meets in one task.
    """
    names = df.columns
    order = _content_hash(names) if key is None else key_hash(seed, key)
    group_value = F.lit(0) if group is None else F.col(group)
    hashed = df.withColumn("__g", group_value).withColumn("__hash", order)
    whole, cuts = _narrow(hashed, quotas)

    picked: Column = F.lit(False)
    at_cut: Column = F.lit(False)
    for g in quotas:
        here = F.col("__g").eqNullSafe(F.lit(g))
        if g in whole:
            picked = F.when(here, F.lit(whole[g])).otherwise(picked)
            continue
        cut, wanted, _ = cuts[g]
        picked = F.when(here, F.col("__hash") < cut).otherwise(picked)
        if wanted > 0:
            at_cut = at_cut | (here & (F.col("__hash") == cut))
    result = hashed.filter(~at_cut).select(*names, picked.alias(flag))
    for g, (cut, wanted, _) in cuts.items():
        if wanted > 0:
            same = hashed.filter(F.col("__g").eqNullSafe(F.lit(g)) & (F.col("__hash") == cut)).select(*names)
            result = result.unionByName(_split_same(same, wanted, flag, by_content=key is not None))
    return result


def _split_same(same: DataFrame, wanted: int, flag: str, by_content: bool) -> DataFrame:
    if by_content:
        return draw(same, {0: wanted}, group=None, flag=flag)
    counted = same.groupBy(*same.columns).agg(F.count("*").alias("__n"))
    yes = replicate(counted, F.lit(wanted), "__i").select(*same.columns, F.lit(True).alias(flag))
    no = replicate(counted, F.col("__n") - wanted, "__i").select(*same.columns, F.lit(False).alias(flag))
    return yes.unionByName(no)


def smallest_by_hash(df: DataFrame, n: int, *, seed: int, key: str) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), those with the smallest hash of seed and key."""
    return draw(df, {0: n}, group=None, seed=seed, key=key, flag="__in").filter("__in").drop("__in")
