"""Statistics of repeated measurements. All percentiles are exact, with linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brooklog.session import shared_table

#: Fixed table: the class of scenarios that a measured operation is compared in.
CLASSES = {"publish": "publish-only", "consume_ack": "consume-with-ack", "consume": "consume-without-ack"}
#: Stability: relative ranges in percent, and repetitions.
THROUGHPUT_RANGE, P99_RANGE, LEAST_REPETITIONS, MOST_REPETITIONS = 10.0, 20.0, 3, 7


def pct(x: str | Column, p: float) -> Column:
    return F.percentile(x, F.lit(p / 100))


def comparison_class(operation: Column) -> Column:
    """The class of a measured operation; null if it has none, which no comparison accepts."""
    return F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])[operation]


def percentiles(samples: DataFrame, group: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """One column for each named percentile; a group without values has 0.0."""
    return samples.groupBy(*group).agg(F.count(value).alias("samples"), *[F.coalesce(pct(value, p), F.lit(0.0)).alias(n) for n, p in ps.items()])


def percentiles_by_rank(samples: DataFrame, group: str, value: str, ps: dict[str, float]) -> DataFrame:
    """As percentiles, for groups too large for one task: equal values are counted, sorted by ranges over all tasks, and the values at the wanted
    ranks are looked up among running counts. The sorted counts are written once, so that their ranges stay what they were. Nulls don't count,
    and a group of nulls only has 0.0."""
    sizes = samples.groupBy(F.col(group).alias("_g")).agg(F.count(value).alias("samples"))
    counted = samples.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = shared_table(counted.repartitionByRange(group, "_v").withColumn("_part", F.spark_partition_id()), "ranks")
    before = Window.partitionBy("_bg").orderBy("_bp").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(F.col(group).alias("_bg"), F.col("_part").alias("_bp")).agg(F.sum("_n").alias("_bn"))
    bases = bases.select("_bg", "_bp", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ends = ranged.withColumn("_in", F.sum("_n").over(inside)).join(F.broadcast(bases), same(group, "_bg") & (F.col("_part") == F.col("_bp")))
    # rank r belongs to the value whose running count first exceeds it
    held = ends.join(F.broadcast(sizes), same(group, "_g")).withColumn("_to", F.col("_base") + F.col("_in")).withColumn("_from", F.col("_to") - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    place = {name: (F.col("samples") - 1) * F.lit(p / 100) for name, p in ps.items()}
    found = held.groupBy(F.col(group).alias("_f")).agg(*[x for n, r in place.items() for x in (at(F.floor(r)).alias(f"_{n}_low"), at(F.ceil(r)).alias(f"_{n}_high"))])
    j = sizes.join(found, same("_g", "_f"), "left")
    mixed = lambda n: F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * (place[n] - F.floor(place[n]))
    return j.select(F.col("_g").alias(group), "samples", *[F.coalesce(mixed(n), F.lit(0.0)).alias(n) for n in ps])


def scenario_metric(samples: DataFrame, group: list[str], latency_us: str, elapsed_s: Column, bytes_each: int) -> DataFrame:
    """Messages, elapsed ms, messages and megabytes a second, and latency percentiles of each scenario."""
    n = F.count(latency_us)
    return samples.groupBy(*group).agg(
        n.alias("messages"), (elapsed_s * 1000).alias("elapsed_ms"), (n / elapsed_s).alias("messages_per_second"), (n * bytes_each / elapsed_s / 1e6).alias("megabytes_per_second"),
        pct(latency_us, 50).alias("p50_us"), pct(latency_us, 99).alias("p99_us"), pct(latency_us, 99.9).alias("p999_us"), F.max(latency_us).alias("max_us"),
    )


def batch_metric(batches: DataFrame, group: list[str], latency: str, size: str, elapsed_s: Column) -> DataFrame:
    """Latency over batches, throughput over the records in them."""
    return batches.groupBy(*group).agg(F.count(F.lit(1)).alias("batches"), F.sum(size).alias("records"), (F.sum(size) / elapsed_s).alias("records_per_second"), pct(latency, 50).alias("p50"), pct(latency, 99).alias("p99"))


def summarize_stats(samples: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Average and maximum of each field, only where every sample of the group has it."""
    whole = lambda c: F.count(c) == F.count(F.lit(1))
    return samples.groupBy(*group).agg(F.count(F.lit(1)).alias("samples"), *[x for c in fields for x in (F.when(whole(c), F.avg(c)).alias(f"{c}_avg"), F.when(whole(c), F.max(c)).alias(f"{c}_max"))])


def per_node(samples: DataFrame, node: str, t: str, cpu: str, memory: str) -> DataFrame:
    """(node, cpu_seconds, memory_avg, memory_max): CPU is the last reading less the first, never below 0."""
    used = F.greatest(F.max_by(cpu, t) - F.min_by(cpu, t), F.lit(0.0))
    return samples.groupBy(node).agg(used.alias("cpu_seconds"), F.avg(memory).alias("memory_avg"), F.max(memory).alias("memory_max"))


def conditional_max(samples: DataFrame, group: str, value: str, when: Column) -> DataFrame:
    """(group, matching, value_max): over the rows where the condition holds."""
    return samples.groupBy(group).agg(F.count_if(when).alias("matching"), F.max(F.when(when, F.col(value))).alias("value_max"))


def latency_summary(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, sample_count, p50, p95, p99, max); a group without values has 0.0."""
    return percentiles(samples, group, value, {"p50": 50, "p95": 95, "p99": 99}).withColumnRenamed("samples", "sample_count").join(samples.groupBy(*group).agg(F.coalesce(F.max(value), F.lit(0.0)).alias("max")), group)


def scenario_summary(values: DataFrame, keys: list[str], metrics: list[str], order: str) -> DataFrame:
    """(keys, metric, and what repetition_summary says of it) for each metric that a scenario has a number of; one pass over all metrics."""
    long = values.select(*keys, order, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return repetition_summary(long.filter(F.col("value").isNotNull()), [*keys, "metric"], "value", order)


def repetition_summary(values: DataFrame, group: list[str], value: str, order: str | None = None) -> DataFrame:
    """Count, minimum, median, maximum, population deviation, and range and deviation in percent of the median.

    With order, also samples: the group's values, which are its repetitions and so few, in that order.
    """
    median = pct(value, 50)
    listed = [F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, F.col(value).alias("_v"))))), lambda x: x["_v"]).alias("samples")] if order else []
    base = F.nullif(F.abs(median), F.lit(0.0))
    return values.groupBy(*group).agg(
        F.count(value).alias("count"), F.min(value).alias("minimum"), median.alias("median"), F.max(value).alias("maximum"), F.stddev_pop(value).alias("stdev"),
        ((F.max(value) - F.min(value)) / base * 100).alias("relative_range_percent"), (F.stddev_pop(value) / base * 100).alias("relative_stdev_percent"), *listed,
    )


def median_or_first(values: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """(group, number, text): the median if every value is a number, else the first value."""
    number = F.expr(f"try_cast(`{value}` AS double)")
    numeric = F.count(number) == F.count(F.lit(1))
    return values.groupBy(*group).agg(F.when(numeric, pct(number, 50)).alias("number"), F.when(~numeric, F.min_by(value, order)).alias("text"))


def cpu_efficiency(samples: DataFrame, group: list[str], messages: str, cpu: str) -> DataFrame:
    """Messages for each CPU second, where both are above 0."""
    m, c = F.sum(messages), F.sum(cpu)
    return samples.groupBy(*group).agg(F.when((m > 0) & (c > 0), m / c).alias("messages_per_cpu_second"))


def consistency_violations(runs: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field, values): fields that differ between the runs of a group; null counts as a value."""
    kinds = [F.struct(F.lit(f).alias("field"), (F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias("values")) for f in fields]
    return runs.groupBy(group).agg(F.array(*kinds).alias("_k")).select(group, F.inline("_k")).filter(F.col("values") > 1)


def tukey_outliers(values: DataFrame, group: str, value: str, keep: list[str]) -> DataFrame:
    """Rows outside the quartiles by more than 1.5 interquartile ranges; groups of under 4 have none.

    Fences are one aggregate row for each group, joined back, so no task holds a whole group.
    """
    q = values.groupBy(F.col(group).alias("_g")).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count(value).alias("_n")).filter(F.col("_n") >= 4)
    spread = (F.col("_q")[1] - F.col("_q")[0]) * 1.5
    fenced = q.select("_g", (F.col("_q")[0] - spread).alias("low"), (F.col("_q")[1] + spread).alias("high"))
    return values.join(fenced, F.col(group) == F.col("_g")).filter((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).select(*keep, "low", "high")


def relative_range(values: DataFrame, group: list[str], value: str) -> DataFrame:
    m = pct(value, 50)
    return values.groupBy(*group).agg(F.when(F.count(value) >= 2, (F.max(value) - F.min(value)) / F.nullif(F.abs(m), F.lit(0.0)) * 100).alias("relative_range"))


def paired_samples(current: DataFrame, baseline: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """(group, place, current, baseline, outlier): the samples of both sides by their place in order of index, as far as the shorter side goes.

    A pair is an outlier if either value lies outside the Tukey fences of its side's paired samples.
    """
    w = Window.partitionBy(group).orderBy(index)
    side = lambda df, name: df.select(F.col(group), (F.row_number().over(w) - 1).alias("place"), F.col(value).cast("double").alias(name))
    pairs = side(current, "current").join(side(baseline, "baseline"), [group, "place"])
    quartiles = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_{c}") for c in ("current", "baseline")]
    fences = pairs.groupBy(F.col(group).alias("_g")).agg(*quartiles, F.count(F.lit(1)).alias("_n"))

    def outside(c: str) -> Column:
        low, high = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        return (F.col(c) < low - 1.5 * (high - low)) | (F.col(c) > high + 1.5 * (high - low))

    j = pairs.join(fences, F.col(group) == F.col("_g"))
    return j.select(group, "place", "current", "baseline", ((F.col("_n") >= 4) & (outside("current") | outside("baseline"))).alias("outlier"))


def paired_direction(current: DataFrame, baseline: DataFrame, group: str, index: str, value: str, higher_is_better: bool) -> DataFrame:
    """One row: how scenarios moved, by the medians of their paired samples without outliers.

    (status, direction, median_delta_percent, improved, worsened, neutral, scenarios, paired_samples); scenarios whose baseline
    median is 0 don't count, and without any the status is unavailable and the rest null or 0.
    """
    kept = paired_samples(current, baseline, group, index, value).filter(~F.col("outlier"))
    each = kept.groupBy(group).agg(pct("current", 50).alias("_c"), pct("baseline", 50).alias("_b"), F.count(F.lit(1)).alias("_n")).filter(F.col("_b") != 0)
    moved = each.withColumn("_d", (F.col("_c") - F.col("_b")) / F.abs("_b") * 100)
    better = F.col("_d") > 0 if higher_is_better else F.col("_d") < 0
    g = moved.agg(
        F.count_if(better).alias("improved"), F.count_if(~better & (F.col("_d") != 0)).alias("worsened"), F.count_if(F.col("_d") == 0).alias("neutral"),
        F.count(F.lit(1)).alias("scenarios"), F.coalesce(F.sum("_n"), F.lit(0)).alias("paired_samples"), pct("_d", 50).alias("median_delta_percent"),
    )
    direction = F.when(F.col("improved") > F.col("worsened"), "generally improved").when(F.col("worsened") > F.col("improved"), "generally worsened").otherwise("mixed/unclear")
    some = F.col("scenarios") > 0
    return g.select(F.when(some, "available").otherwise("unavailable").alias("status"), F.when(some, direction).alias("direction"), "median_delta_percent", "improved", "worsened", "neutral", "scenarios", "paired_samples")


def stability(values: DataFrame, group: str, throughput: str, p99: str) -> DataFrame:
    """(group, repetitions, throughput_range, p99_range, status, reasons)."""

    def spread(c: str) -> Column:
        return (F.max(c) - F.min(c)) / F.nullif(F.abs(pct(c, 50)), F.lit(0.0)) * 100

    g = values.groupBy(group).agg(F.count(F.lit(1)).alias("repetitions"), spread(throughput).alias("throughput_range"), spread(p99).alias("p99_range"))
    few = F.when(F.col("repetitions") < LEAST_REPETITIONS, "too few repetitions")
    wide = F.when(F.col("throughput_range") > THROUGHPUT_RANGE, "throughput varies")
    slow = F.when(F.col("p99_range") > P99_RANGE, "p99 varies")
    reasons = F.array_join(F.filter(F.array(few, wide, slow), lambda x: x.isNotNull()), "; ")
    return g.withColumn("reasons", reasons).withColumn("status", F.when(F.col("reasons") == "", "stable").otherwise("inconclusive"))


def assess_stability(current: DataFrame, baseline: DataFrame, group: str, throughput: str, p99: str, fixed: bool = False) -> DataFrame:
    """One row (status, repetitions, throughput_range, p99_range, reasons): whether the repetitions of both sides are alike enough.

    Ranges are the largest of all groups and both sides; repetitions are those of the group that has the fewest. A run of a
    fixed number of repetitions is `fixed-repetitions`, whatever its ranges.
    """
    both = [relative_range(df, [group], c).select(F.lit(c).alias("_m"), "relative_range") for df in (current, baseline) for c in (throughput, p99)]
    ranges = both[0].unionByName(both[1]).unionByName(both[2]).unionByName(both[3])
    most = ranges.agg(*[F.max(F.when(F.col("_m") == c, F.col("relative_range"))).alias(n) for c, n in ((throughput, "throughput_range"), (p99, "p99_range"))])
    few = current.groupBy(group).count().unionByName(baseline.groupBy(group).count()).agg(F.coalesce(F.min("count"), F.lit(0)).alias("repetitions"))
    j = most.join(few)  # one row each
    t, p, n = F.col("throughput_range"), F.col("p99_range"), F.col("repetitions")
    stable = (n >= LEAST_REPETITIONS) & (t.isNotNull() | p.isNotNull()) & F.coalesce(t <= THROUGHPUT_RANGE, F.lit(True)) & F.coalesce(p <= P99_RANGE, F.lit(True))
    reasons = F.array(
        F.when(n < LEAST_REPETITIONS, "minimum repetitions were not reached"),
        F.when(t.isNull(), "no throughput range was available").when(t > THROUGHPUT_RANGE, "throughput range exceeded its limit"),
        F.when(p.isNull(), "no p99 range was available").when(p > P99_RANGE, "p99 range exceeded its limit"),
    )
    status = F.lit("fixed-repetitions") if fixed else F.when(stable, "stable").otherwise("inconclusive")
    return j.select(status.alias("status"), "repetitions", "throughput_range", "p99_range", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "; ").alias("reasons"))


def growth_summary(samples: DataFrame, node: str, t: str, retained: str, purged: str, file_bytes: str) -> DataFrame:
    """(node, peak_retained, purge_transitions, file_bytes_delta) of a node's samples in order of t, the first of which is its start.

    A transition is a known purge index above the last known one, or the first known one.
    """
    w = Window.partitionBy(node).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy(node).orderBy(t))
    last = F.last(purged, ignorenulls=True).over(w)
    up = F.col(purged).isNotNull() & (last.isNull() | (F.col(purged) > last)) & (place > 1)
    g = samples.withColumn("_up", up).groupBy(node)
    return g.agg(F.max(retained).alias("peak_retained"), F.count_if("_up").alias("purge_transitions"), (F.max_by(file_bytes, t) - F.min_by(file_bytes, t)).alias("file_bytes_delta"))


def aggregate_per_node(values: DataFrame, group: list[str], node: str, fields: list[str], order: str) -> DataFrame:
    """median_or_first of each field over the repetitions that have the node: (group, node, field, number, text)."""
    long = values.select(*group, node, order, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("_v")) for f in fields])))
    keys = [*group, node, "field"]
    number = F.expr("try_cast(_v AS double)")
    numeric = F.count(number) == F.count(F.lit(1))
    return long.groupBy(*keys).agg(F.when(numeric, pct(number, 50)).alias("number"), F.when(~numeric, F.min_by("_v", order)).alias("text"))


def percent_delta(now: Column, old: Column) -> Column:
    """Change in percent of the old value's size; null if either is missing or not finite, or the old one is 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite(now.cast("double")) & finite(old.cast("double")) & (old != 0), (now - old) / F.abs(old) * 100)


def series_of(suite: Column, backend: Column, own: str) -> Column:
    """The history series of a measurement: of the own backend its suite or native comparison, else the suite."""
    return F.when((backend == own) & (suite == own), own).when((backend == own) & (suite == "native-comparison"), f"{own}-native-comparison").otherwise(suite)


def time_ticks(points: DataFrame, t: str, most: int = 5) -> DataFrame:
    """(t): up to `most` of the distinct times, evenly spaced by place, the first and last among them. The limit is the axis's own."""
    times = points.select(t).filter(F.col(t).isNotNull()).distinct()
    placed = percentile_places(times, t)
    n = F.col("_n")
    ticks = F.least(F.lit(most), n)
    wanted = F.transform(F.sequence(F.lit(0), ticks - 1), lambda i: F.when(ticks > 1, F.floor(i * (n - 1) / (ticks - 1) + 0.5)).otherwise(0))
    return placed.filter(F.array_contains(wanted, F.col("_place"))).select(t)


def percentile_places(values: DataFrame, value: str) -> DataFrame:
    """value with _place, its rank from 0, and _n, how many there are; ranks are counted in ranges, so no task sorts all."""
    ranged = shared_table(values.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "places")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).collect()  # one row for each range
    bases, at = {}, 0
    for part, n in sorted((r["_part"], r["_c"]) for r in sizes):
        bases[part], at = at, at + n
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in bases.items() for x in kv])[F.col("_part")], F.lit(0)) if bases else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(value)) - 1
    return ranged.withColumn("_place", (base + inside).cast("long")).withColumn("_n", F.lit(at).cast("long")).drop("_part")


def log_ticks(low: Column, high: Column) -> Column:
    """Ticks of a logarithmic axis: both ends and the powers of ten between them; null unless 0 < low <= high."""
    powers = F.transform(F.sequence(F.ceil(F.log10(low)), F.greatest(F.floor(F.log10(high)), F.ceil(F.log10(low)))), lambda p: F.pow(F.lit(10.0), p))
    inner = F.filter(powers, lambda v: (v > low) & (v < high))
    return F.when((low > 0) & (low <= high), F.array_distinct(F.concat(F.array(low.cast("double")), inner, F.array(high.cast("double")))))


def rolling_median(points: DataFrame, series: str, order: str, value: str, width: int = 5) -> DataFrame:
    """Adds rolling_median over the last `width` points of each series."""
    w = Window.partitionBy(series).orderBy(order).rowsBetween(1 - width, 0)
    return points.withColumn("rolling_median", F.percentile(value, F.lit(0.5)).over(w))


def delta_vs_previous(points: DataFrame, series: str, order: str, value: str, higher_is_better: bool) -> DataFrame:
    """Adds previous, delta, delta_percent (over the signed old value) and improved (strict)."""
    w = Window.partitionBy(series).orderBy(order)
    old, now = F.col("previous"), F.col(value)
    d = points.withColumn("previous", F.lag(value).over(w)).withColumn("delta", now - old)
    better = F.col("delta") > 0 if higher_is_better else F.col("delta") < 0
    return d.withColumn("delta_percent", F.col("delta") / F.nullif(old, F.lit(0.0)) * 100).withColumn("improved", better)


def baseline_delta(current: DataFrame, baseline: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, current, baseline, delta_percent): the first baseline row of a key wins; percent over its size."""
    first = baseline.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(value, order).alias("baseline"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    b = F.col("baseline")
    return current.join(first, cond, "left").select(*keys, F.col(value).alias("current"), "baseline", F.when(b != 0, (F.col(value) - b) / F.abs(b) * 100).alias("delta_percent"))


def unpivot_points(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row (ids, metric, value) for each metric that isn't null."""
    return rows.unpivot(ids, metrics, "metric", "value").filter(F.col("value").isNotNull())


def increases(samples: DataFrame, node: str, t: str, value: str) -> DataFrame:
    """(node, increases): how often the value rose over its last known one; nulls are passed over."""
    w = Window.partitionBy(node).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(value, ignorenulls=True).over(w)
    return samples.withColumn("_up", F.col(value) > last).groupBy(node).agg(F.count_if("_up").alias("increases"))


def budget_checks(measured: DataFrame, upper: dict[str, float], lower: dict[str, float], exact: dict[str, float] | None = None) -> DataFrame:
    """Adds pass for each upper, lower or exact budget and passed for all of them; a null measure passes none."""
    checks = {f"{c}_ok": F.col(c) <= v for c, v in upper.items()} | {f"{c}_ok": F.col(c) >= v for c, v in lower.items()} | {f"{c}_ok": F.col(c) == v for c, v in (exact or {}).items()}
    checks = {c: F.coalesce(ok, F.lit(False)) for c, ok in checks.items()}
    out = measured.withColumns(checks)
    every = F.lit(True)
    for c in checks:
        every = every & F.col(c)
    return out.withColumn("passed", every)


def facets(points: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): distinct values of each column."""
    rows = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return points.select(F.inline(rows)).distinct()


def latest_changes(points: DataFrame, run: str, previous: str, improved: str) -> DataFrame:
    """Rows of the last run that have a previous value, marked Improved or Regressed (a tie is Regressed)."""
    last = points.agg(F.max(run).alias("_last"))
    rows = points.join(last, F.col(run) == F.col("_last")).filter(F.col(previous).isNotNull()).drop("_last")
    return rows.withColumn("change", F.when(F.col(improved), "Improved").otherwise("Regressed"))


def first_stable_attempt(attempts: DataFrame, group: str, attempt: str, stable: Column, hard_failure: Column) -> DataFrame:
    """(group, stopped_at, result): the first attempt that is stable or fails hard; else the last."""
    end = stable | hard_failure
    g = attempts.groupBy(group).agg(F.min(F.when(end, F.col(attempt))).alias("_end"), F.max(attempt).alias("_last"), F.min_by(F.when(stable, "stable").when(hard_failure, "failed"), F.when(end, F.col(attempt))).alias("_what"))
    return g.select(group, F.coalesce("_end", "_last").alias("stopped_at"), F.coalesce("_what", F.lit("inconclusive")).alias("result"))


def format_number(n: Column, decimals: int = 1) -> Column:
    """A number with thousands commas and at most `decimals` decimals, without zeros at the end; null if it isn't finite."""
    x = n.cast("double")
    whole, part = F.format_number(x, 0), F.regexp_replace(F.format_number(x, decimals), r"\.?0+$", "")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.when(x == F.floor(x), whole).otherwise(part))


def format_bytes(n: Column) -> Column:
    """Bytes in the largest fitting binary unit up to TiB; null if negative."""
    out = F.concat(format_number(n), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.concat(format_number(n / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n >= 0, out)


def format_duration(us: Column) -> Column:
    """Microseconds as µs, ms or s; null if negative."""
    said = F.when(us >= 1e6, F.concat(format_number(us / 1e6, 2), F.lit(" s"))).when(us >= 1e3, F.concat(format_number(us / 1e3, 2), F.lit(" ms"))).otherwise(F.concat(format_number(us, 2), F.lit(" µs")))
    return F.when(us >= 0, said)


def format_percent(x: Column, signed: bool = False) -> Column:
    """A percentage; signed ones always show their sign and one decimal, others are null if negative."""
    if signed:
        return F.concat(F.when(x >= 0, "+").otherwise("-"), F.replace(F.format_number(F.abs(x.cast("double")), 1), F.lit(","), F.lit("")), F.lit("%"))
    return F.when(x >= 0, F.concat(format_number(x), F.lit("%")))


def bound_text(text: Column, most: int = 120) -> Column:
    """A table cell of at most `most` characters, the last of which is an ellipsis if it was longer; line ends become blanks, and
    markup and table marks are escaped."""
    flat = F.trim(F.translate(text, "\r\n", "  "))
    cut = F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)
    for mark, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\"), ("|", "\\|")):
        cut = F.replace(cut, F.lit(mark), F.lit(safe))
    return cut
