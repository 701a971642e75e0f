"""The small tables behind charts. Drawing is left to the reader's own tools."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import limits
from tallyframe.functions import col, family, is_missing, known, numeric_columns, text_columns
from tallyframe.functions.columns import as_double, columns_of, present, unpivot
from tallyframe.operators.aggregate import top_n_with_others, value_counts
from tallyframe.operators.missing import missing_profile

from .correlation import heatmap
from .quantiles import grouped_quantiles, table_quantiles
from .statistics import distinct_counts, few_rows, moments, per_column
from .storage import local_copy


def value_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per column, in one pass; columns without values are absent."""
    rows = per_column(
        df, columns, lambda c: {"lo": F.min(as_double(df, c)), "hi": F.max(as_double(df, c))}
    ).collect()
    return {r["column"]: (r["lo"], r["hi"]) for r in rows if r["lo"] is not None}


def bin_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width edges; a single value gets a bin half a unit to either side."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [lo + i * step for i in range(bins)] + [hi]


def bin_index(v: Column, edges: list[float]) -> Column:
    """Zero-based bin of a value; every bin is closed on the left, the last on both sides.

    The division gives the bin but for rounding; comparing with the edges
    themselves settles values that lie on one.
    """
    bins = len(edges) - 1
    lo, hi = edges[0], edges[-1]
    guess = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    table = F.array(*[F.lit(e) for e in edges])
    # least() passes over a missing value, so that is tested for first.
    return (
        F.when(v.isNull(), F.lit(None).cast("int"))
        .when(v < table[guess], guess - 1)
        .when((guess < bins - 1) & (v >= table[guess + 1]), guess + 1)
        .otherwise(guess)
    )


def histograms(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """``column, bin, lo, hi, count`` for several columns in one job, empty bins included."""
    ranges = value_ranges(df, list(bins))
    edges = {c: bin_edges(*ranges[c], bins[c]) for c in bins if c in ranges}
    spine = few_rows(
        df,
        [(c, i, e[i], e[i + 1]) for c, e in edges.items() for i in range(len(e) - 1)],
        "`column` string, bin int, lo double, hi double",
    )
    if not edges:
        return spine.withColumn("count", F.lit(0).cast("bigint"))
    binned = unpivot(df, {c: bin_index(as_double(df, c), e) for c, e in edges.items()})
    counted = binned.groupBy("column", F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Both sides have one row per bin.
    return spine.join(F.broadcast(counted), ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("count")
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``bin, lo, hi, count``; a text column gives its category counts instead."""
    if family(df.schema[column].dataType) == "text":
        return bar_counts(df, column)
    return histograms(df, {column: bins}).drop("column").orderBy("bin")


def profile_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    return histograms(df, {c: bins for c in numeric_columns(df, columns)})


def capped_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """At most ``bins`` bins and no more than there are distinct values."""
    names = numeric_columns(df, columns)
    counts = distinct_counts(df, names).collect()
    return histograms(df, {r["column"]: min(bins, r["unique_count"]) for r in counts})


def fitted_histogram(df: DataFrame, column: str, few: int = 10, most_bins: int = 30) -> DataFrame:
    """``bin, lo, hi, count``: a bar per value where there are at most ``few``, else as many bins as values, up to ``most_bins``."""
    found = {r["column"]: r["unique_count"] for r in distinct_counts(df, [column]).collect()}
    distinct = found.get(column, 0)
    if distinct > few:
        return histogram(df, column, min(most_bins, distinct))
    counted = df.where(~is_missing(df, column)).groupBy(as_double(df, column).alias("lo")).agg(F.count(F.lit(1)).alias("count"))
    order = Window.orderBy("lo")  # ``few`` rows at most
    return counted.select((F.row_number().over(order) - 1).alias("bin"), "lo", F.col("lo").alias("hi"), "count").orderBy("bin")


def density(df: DataFrame, column: str, points: int = 200, fine_bins: int = 1000, cut: float = 3.0) -> DataFrame:
    """``x, density``: Gaussian kernel density with Scott's bandwidth.

    The values are first counted into fine bins, whose midpoints then stand
    for them; the kernel sum runs over bins and grid points, not rows.
    """
    facts = moments(df, [column]).first()
    if not facts["count"]:
        raise ValueError(f"no value in {column}")
    width = (facts["std"] or 0.0) * facts["count"] ** (-1 / 5)
    if width == 0.0:
        raise ValueError(f"{column} has a single value: no density")
    start, stop = facts["min"] - cut * width, facts["max"] + cut * width
    step = (stop - start) / (points - 1)
    filled = histograms(df, {column: fine_bins}).where("count > 0")
    z = (F.col("x") - (F.col("lo") + F.col("hi")) / 2) / F.lit(width)
    kernel = F.exp(-z * z / 2) * F.col("count")
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(start) + i * F.lit(step))
    return (
        filled.withColumn("x", F.explode(grid))
        .groupBy("x")
        .agg((F.sum(kernel) / F.lit(facts["count"] * width * math.sqrt(2 * math.pi))).alias("density"))
        .orderBy("x")
    )


def bar_counts(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    return value_counts(df, column, top_n)


def pie_shares(df: DataFrame, column: str, top_n: int = 5, others: bool = True) -> DataFrame:
    return top_n_with_others(df, column, top_n, others)


def scatter_points(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Every point with both coordinates (and hue) present; durations as seconds."""
    names = known(df, [x, y] + ([hue] if hue else []))
    rows = df
    for n in names:
        rows = rows.where(~is_missing(df, n))
    out = [as_double(df, c).alias(c) if family(df.schema[c].dataType) == "timedelta" else present(df, c).alias(c) for c in names]
    return rows.select(out)


def scatter_grid(df: DataFrame, x: str, y: str, hue: str | None = None, cells: int = 50) -> DataFrame:
    """``gx, gy, count`` (and hue): how many points fall into each cell of a square grid."""
    rows = scatter_points(df, x, y, hue)
    ranges = value_ranges(rows, [x, y])
    if len(ranges) < len({x, y}):
        raise ValueError("no complete point")
    keys = [
        bin_index(as_double(rows, x), bin_edges(*ranges[x], cells)).alias("gx"),
        bin_index(as_double(rows, y), bin_edges(*ranges[y], cells)).alias("gy"),
        *([col(hue).alias("hue")] if hue and hue in rows.columns else []),
    ]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def pair_grid(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    hue: str | None = None,
    max_cols: int | None = None,
    cells: int = 20,
) -> DataFrame:
    """``col_x, col_y, gx, gy, count`` (and hue) for every pair, over rows where all are present.

    The diagonal (``col_x = col_y``) holds the histogram of that column in
    ``gx`` with ``gy`` 0. One job serves all pairs.
    """
    allowed = columns_of(df, "integer", "float", "timedelta")
    names = allowed if columns is None else [c for c in known(df, columns) if c in allowed]
    names = names[:max_cols] if columns is None and max_cols else names
    if not names:
        raise ValueError("no numeric column to pair")
    hue = hue if hue and hue in df.columns else None
    rows = df
    for n in [*names, *([hue] if hue else [])]:
        rows = rows.where(~is_missing(df, n))
    ranges = value_ranges(rows, names)
    if not ranges:
        raise ValueError("no complete row")
    binned = {n: bin_index(as_double(df, n), bin_edges(*ranges[n], cells)) for n in names}
    # Bins first, so that each is worked out once per row and not once per pair.
    flat = rows.select(
        *[b.alias(f"_b{i}") for i, b in enumerate(binned.values())], *([col(hue).alias("hue")] if hue else [])
    )
    pairs = [
        F.struct(
            F.lit(names[i]).alias("col_x"),
            F.lit(names[j]).alias("col_y"),
            F.col(f"_b{i}").alias("gx"),
            (F.lit(0) if i == j else F.col(f"_b{j}")).alias("gy"),
        )
        for i in range(len(names))
        for j in range(i, len(names))
    ]
    extra = ["hue"] if hue else []
    long = flat.select(*extra, F.inline(F.array(*pairs)))
    return long.groupBy("col_x", "col_y", "gx", "gy", *extra).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, column: str, by: str | None = None, reach: float = 1.5, exact: bool = True) -> DataFrame:
    """``q1, median, q3, whisker_low, whisker_high, outliers, count`` per group.

    Whiskers end at the furthest values within ``reach`` interquartile ranges.
    """
    probs = [0.25, 0.5, 0.75]
    rows = df.where(~is_missing(df, column))
    v = as_double(df, column)
    if by is None:
        q = table_quantiles(rows, [column], probs, exact=exact)[column]
        if q[0.5] is None:
            raise ValueError(f"no value in {column}")
        marks = {"q1": 0.25, "median": 0.5, "q3": 0.75}
        placed = rows.select(v.alias("_v"), *[F.lit(q[p]).alias(n) for n, p in marks.items()])
        keys: list[str] = []
    else:
        rows = rows.where(~is_missing(df, by))
        long = grouped_quantiles(rows, [by], [column], probs, exact=exact)
        q = F.col("q")
        boxes = long.select(col(by).alias("_by"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
        copy = local_copy(boxes, limits.BROADCAST_ROWS)
        boxes = boxes if copy is None else F.broadcast(copy)
        placed = rows.select(col(by), v.alias("_v")).join(boxes, col(by) == F.col("_by")).drop("_by")
        keys = [by]
    span = (F.col("q3") - F.col("q1")) * reach
    inside = F.col("_v").between(F.col("q1") - span, F.col("q3") + span)
    return placed.groupBy(*[col(k) for k in keys], "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
        F.count(F.lit(1)).alias("count"),
    )


def box_outliers(df: DataFrame, column: str, by: str | None = None, reach: float = 1.5, exact: bool = True) -> DataFrame:
    """The points drawn beyond the whiskers, all of them."""
    v = as_double(df, column)
    rows = df.where(~is_missing(df, column)).select(*([col(by)] if by else []), v.alias("value"))
    span = (F.col("q3") - F.col("q1")) * reach
    lo, hi = F.col("q1") - span, F.col("q3") + span
    boxes = box_stats(df, column, by, reach, exact)
    if by is None:
        fence = boxes.select(lo.alias("lo"), hi.alias("hi")).first()
        return rows.where((F.col("value") < fence["lo"]) | (F.col("value") > fence["hi"]))
    fences = boxes.select(col(by).alias("_by"), lo.alias("_lo"), hi.alias("_hi"))
    copy = local_copy(fences, limits.BROADCAST_ROWS)
    fences = fences if copy is None else F.broadcast(copy)
    beyond = (F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))
    return rows.join(fences, col(by) == F.col("_by")).where(beyond).select(col(by), "value")


def top_variance(df: DataFrame, top_n: int = 5) -> DataFrame:
    """``column, variance`` of the numeric columns that vary most."""
    return (
        moments(df, numeric_columns(df))
        .select("column", F.col("var").alias("variance"))
        .orderBy(F.desc_nulls_last("variance"), "column")
        .limit(top_n)
    )


def _uniform(chart: str, kind: str, table: DataFrame, label: Column, value: str | Column, **extra: Column) -> DataFrame:
    """All charts share ``chart_id, kind, series, label, x, y, value`` so that they stack into one table."""
    nothing = F.lit(None)
    return table.select(
        F.lit(chart).alias("chart_id"),
        F.lit(kind).alias("kind"),
        extra.get("series", nothing).cast("string").alias("series"),
        label.cast("string").alias("label"),
        extra.get("x", nothing).cast("double").alias("x"),
        extra.get("y", nothing).cast("double").alias("y"),
        (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"),
    )


def chart_bundle(df: DataFrame, columns: Sequence[str] | None = None, correlations: bool = True, scatters: int | None = 2, box_texts: int | None = 3, box_numbers: int | None = 2) -> DataFrame:
    """Chart tables chosen by rule, stacked and told apart by ``chart_id``.

    Missing counts; a histogram per numeric column; bars per text column, and
    a pie where it has at most ten values; the correlation heat map; scatter
    grids of the first ``scatters`` neighbouring numeric pairs; boxes of the
    first ``box_numbers`` numeric columns by those of the first ``box_texts``
    text columns that have at most ten values. None means all of them.
    """
    names = df.columns if columns is None else known(df, columns)
    numbers = [c for c in columns_of(df, "integer", "float", "timedelta") if c in names]
    texts = [c for c in text_columns(df) if c in names]
    few: set[str] = set()
    if texts:
        few = {r["column"] for r in distinct_counts(df, texts).collect() if r["unique_count"] <= 10}

    parts = [_uniform("missing", "missing", missing_profile(df), F.col("column"), "missing_percent")]
    if numbers:
        bars = histograms(df, {c: 20 for c in numbers})
        parts.append(
            _uniform("histogram", "histogram", bars, F.col("bin"), "count", series=F.col("column"), x=F.col("lo"), y=F.col("hi")).withColumn(
                "chart_id", F.concat(F.lit("hist_"), F.col("series"))
            )
        )
    for c in texts:
        parts.append(_uniform(f"bar_{c}", "bar", bar_counts(df, c), F.col("value"), "count"))
        if c in few:
            parts.append(_uniform(f"pie_{c}", "pie", pie_shares(df, c), F.col("value"), "percent"))
    if correlations and len(numbers) >= 2:
        cells = heatmap(df, numbers)
        parts.append(_uniform("correlation", "heatmap", cells, F.col("col_b"), "r", series=F.col("col_a")))
    for a, b in list(zip(numbers, numbers[1:], strict=False))[:scatters]:
        grid = scatter_grid(df, a, b)
        parts.append(
            _uniform(f"scatter_{a}_{b}", "scatter", grid, F.lit(None), "count", x=F.col("gx"), y=F.col("gy"))
        )
    for t in texts[:box_texts]:
        if t not in few:
            continue
        for c in numbers[:box_numbers]:
            boxes = box_stats(df, c, t)
            stats = ["q1", "median", "q3", "whisker_low", "whisker_high"]
            flat = boxes.select(
                col(t).alias("_by"),
                F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in stats])),
            )
            parts.append(_uniform(f"box_{c}_by_{t}", "box", flat, F.col("stat"), "v", series=F.col("_by")))
    return reduce(DataFrame.unionByName, parts)
