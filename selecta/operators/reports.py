"""Report tables (what the reference rendered as plots and pages): A20 side-by-
side comparison, T11 strategy order, F8 membership flags, J8 complement,
J2 selection re-matching, J11 region inspection, J10 plot table, A21 axis
bounds. All are joins / aggregates over whole tables; limits appear only
where the report itself is a first-n page.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strategies listed first on comparison pages, in this order;
# every other strategy follows, sorted by name.
STRATEGY_ORDER = ["random", "coreset", "infoverse", "oe", "rouge"]


def strategy_sort_key(name: Column) -> Column:
    """(position in STRATEGY_ORDER, else len(STRATEGY_ORDER)) then name."""
    pos = F.lit(len(STRATEGY_ORDER))
    for i, s in reversed(list(enumerate(STRATEGY_ORDER))):
        pos = F.when(name.startswith(s), F.lit(i)).otherwise(pos)
    return F.struct(pos.alias("p"), name.alias("n"))


def compare_runs(preds: DataFrame, runs: Iterable, key: str = "row_id", run_col: str = "run",
                 value: str = "pred", first_n: int | None = 50, extra: list[str] | None = None) -> DataFrame:
    """One row per key, one column per run (known values: no extra pass
    to discover them), plus ``extra`` columns; the first ``first_n`` keys."""
    runs = list(runs)
    extra = extra or []
    g = preds.groupBy(key, *extra).pivot(run_col, runs).agg(F.max(value))
    g = g.select(key, *extra, *[F.col(f"`{r}`").alias(f"run_{r}") for r in runs])
    return g.orderBy(key).limit(first_n) if first_n else g


def membership_flags(rows: DataFrame, selections: dict[str, DataFrame], key: str = "row_id") -> DataFrame:
    """F8: one boolean per selection (left joins on the key), plus ``in_none``."""
    out = rows
    for name, sel in selections.items():
        s = sel.select(key).distinct().withColumn(f"in_{name}", F.lit(True))
        out = out.join(s, key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    flags = [F.col(f"in_{n}") for n in selections]
    none = ~flags[0]
    for f in flags[1:]:
        none = none & ~f
    return out.withColumn("in_none", none)


def not_selected(rows: DataFrame, selections: Iterable[DataFrame], key: str = "row_id") -> DataFrame:
    """Rows in none of the selections (left anti joins)."""
    out = rows
    for sel in selections:
        out = out.join(sel.select(key), key, "left_anti")
    return out


def match_selection(selection: DataFrame, rows: DataFrame, on: list[str], key: str = "row_id") -> DataFrame:
    """J2 (Q23): recover row ids of a selection that lost them, by equi-join on
    text columns; duplicate texts multiply, as in the reference."""
    return selection.select(*on).join(rows.select(key, *on), on)


def region_inspect(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every region's members with a flag for the rows chosen there."""
    c = chosen.select("region_id", "pos", F.lit(True).alias("chosen"))
    return members.join(c, ["region_id", "pos"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def axis_bounds(df: DataFrame, x: str, y: str) -> DataFrame:
    """(min - 1, max + 1) of the two plot axes."""
    return df.agg((F.min(x) - 1).alias("x_min"), (F.max(x) + 1).alias("x_max"),
                  (F.min(y) - 1).alias("y_min"), (F.max(y) + 1).alias("y_max"))


# Per-dataset job constants — new-token budget for generation
# and region size for the region selector (anything else: the default row).
DATASET_CONSTANTS = {
    "all": {"max_new_tokens": 250, "region_size": 51},
    "dolly": {"max_new_tokens": 150, "region_size": 14},
    "cleaned_alpaca": {"max_new_tokens": 250, "region_size": 51},
}
DEFAULT_CONSTANTS = {"max_new_tokens": 200, "region_size": 51}


def dataset_constant(data_set: Column, name: str) -> Column:
    """A per-dataset constant as a literal map lookup (no join)."""
    pairs = []
    for k, v in DATASET_CONSTANTS.items():
        pairs += [F.lit(k), F.lit(v[name])]
    return F.coalesce(F.element_at(F.create_map(*pairs), data_set), F.lit(DEFAULT_CONSTANTS[name]))
