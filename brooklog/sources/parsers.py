"""Parsers of text inputs: one line a row, as spark.read.text gives them (value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prometheus(lines: DataFrame) -> DataFrame:
    """(name, value): the first two fields of each line; comments, blank lines and non-numbers are left out. Labels stay in the name."""
    clean = lines.select(F.trim("value").alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    parts = clean.select(F.split("v", r"\s+").alias("p")).select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("t"))
    return parts.select("name", F.expr("try_cast(t AS double)").alias("value")).filter(F.col("value").isNotNull())


def timings(lines: DataFrame) -> DataFrame:
    """(stage, elapsed_us) of lines with stage=... elapsed_us=..."""
    stage = F.regexp_extract("value", r"\bstage=([A-Za-z0-9_.-]+)", 1)
    us = F.nullif(F.regexp_extract("value", r"\belapsed_us=([0-9]+)", 1), F.lit("")).try_cast("long")
    return lines.select(stage.alias("stage"), us.alias("elapsed_us")).filter((F.col("stage") != "") & F.col("elapsed_us").isNotNull())


def stage_summary(rows: DataFrame) -> DataFrame:
    """(stage, count, p50_us, p99_us, max_us)."""
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("count"), F.percentile("elapsed_us", F.lit(0.5)).alias("p50_us"), F.percentile("elapsed_us", F.lit(0.99)).alias("p99_us"), F.max("elapsed_us").alias("max_us"))


def last_number(text: Column, pattern: str) -> Column:
    """The number of the pattern's last match in the text, without thousands commas; null if none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")


def last_match(text: Column, pattern: str, groups: int) -> list[Column]:
    """The groups of the pattern's last match in the text as texts; null if there is none. The pattern may go over no line end."""
    return [F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.lit(-1)) for g in range(1, groups + 1)]


def number(text: Column) -> Column:
    """A number with thousands commas; null if the text is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def journal(lines: DataFrame, schema: str, order: str = "line") -> DataFrame:
    """(line, entry, status) of a JSON journal's lines (line, value): `ok`, `torn` for a last line that is cut off, else `corrupt`.

    A torn line is what a crash leaves and is passed over; a broken line before the last one is an error for the reader to raise.
    """
    parsed = F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    last = lines.agg(F.max(order).alias("_last"))
    j = lines.withColumn("entry", parsed).join(last)  # one row
    good = F.col("entry").isNotNull() & F.col("entry._broken").isNull() & (F.trim("value") != "")
    status = F.when(good, "ok").when(F.col(order) == F.col("_last"), "torn").otherwise("corrupt")
    return j.select(order, F.when(good, F.col("entry").dropFields("_broken")).alias("entry"), status.alias("status"))


def producer_output(text: Column) -> Column:
    """struct(messages, messages_per_second, avg_us, max_us, p50_us, p95_us, p99_us, p999_us) of a producer tool's last summary; null without one."""
    pattern = r"([\d,]+) records sent, ([\d.]+) records/sec .*?([\d.]+) ms avg latency, ([\d.]+) ms max latency, ([\d.]+) ms 50th, ([\d.]+) ms 95th, ([\d.]+) ms 99th, ([\d.]+) ms 99.9th"
    count, rate, *ms = last_match(text, pattern, 8)
    names = ("avg_us", "max_us", "p50_us", "p95_us", "p99_us", "p999_us")
    return F.when(count.isNotNull(), F.struct(number(count).cast("long").alias("messages"), number(rate).alias("messages_per_second"), *[(number(x) * 1000).alias(n) for x, n in zip(ms, names)]))


def consumer_output(text: Column) -> Column:
    """struct(messages, elapsed_ms, messages_per_second, megabytes_per_second) of a consumer tool's last row of values; null without a good one.

    The row has start and end time, megabytes, megabytes a second, messages, messages a second.
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2} .*?,\s+\d{4}-\d{2}-\d{2} .*?,"))
    fields = F.transform(F.split(F.try_element_at(lines, F.lit(-1)), ","), lambda x: F.trim(x))
    at = lambda i: F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.get(fields, F.lit(i)), r":(\d{1,6})$", ".$1")))
    out = F.struct(
        F.get(fields, F.lit(4)).try_cast("long").alias("messages"), ((at(1) - at(0)) / 1000).alias("elapsed_ms"),
        number(F.get(fields, F.lit(5))).alias("messages_per_second"), number(F.get(fields, F.lit(3))).alias("megabytes_per_second"),
    )
    whole = out["messages"].isNotNull() & out["elapsed_ms"].isNotNull() & out["messages_per_second"].isNotNull() & out["megabytes_per_second"].isNotNull()
    return F.when(whole, out)


def stats_output(text: Column) -> Column:
    """struct(messages_per_second, min_us, avg_us, max_us, p50_us, p90_us, p99_us, p999_us) of a tool's first line of statistics; a consumer's
    line has the first only. Null without one."""
    rate = F.nullif(F.regexp_extract(text, r"(?i)stats: ([\d,.]+) msgs/sec", 1), F.lit(""))
    names = {"min_us": "min", "avg_us": "avg", "max_us": "max", "p50_us": "P50", "p90_us": "P90", "p99_us": "P99", "p999_us": r"P99\.9"}
    whole = "(?i)stats: [\\d,.]+ msgs/sec .*?" + " .*?".join(rf"{n}: ([\d,.]+)us" for n in names.values())
    us = [number(F.nullif(F.regexp_extract(text, whole, i), F.lit(""))).alias(n) for i, n in enumerate(names, 1)]
    return F.when(rate.isNotNull(), F.struct(number(rate).alias("messages_per_second"), *us))


def container_stats(row: Column) -> Column:
    """struct(cpu_percent, memory_bytes, memory_percent) of a container tool's JSON row; null if any part is missing."""
    raw = F.from_json(row, "CPUPerc string, MemUsage string, MemPerc string")
    percent = lambda c: F.rtrim(raw[c], F.lit("%")).try_cast("double")
    memory = F.when(raw["MemUsage"].isNotNull(), F.coalesce(size_bytes(F.substring_index(raw["MemUsage"], " / ", 1)), F.lit(0.0)))
    out = F.struct(percent("CPUPerc").alias("cpu_percent"), memory.alias("memory_bytes"), percent("MemPerc").alias("memory_percent"))
    return F.when(out["cpu_percent"].isNotNull() & out["memory_bytes"].isNotNull() & out["memory_percent"].isNotNull(), out)


MANIFEST = (
    "schema_version int, workloads map<string, struct<messages: int, budgets: map<string, double>, registered_observations: "
    "struct<in_flight_deliveries_while_two_held: struct<metric: string, scope: string, held_delivery_count: int, expected_metric_value: int>>>>"
)


def manifest_violations(manifests: DataFrame, metric: str, text: str = "text") -> DataFrame:
    """All columns of manifests with violation: one row for each rule that a JSON manifest breaks.

    It has version 1 and the workloads background_work and events_replay; each workload has budgets, all above 0;
    background_work registers that exactly two held deliveries show as 2 in the named in-flight metric, with a scope, and sends at least two.
    """
    m = F.from_json(F.col(text), MANIFEST)
    loads = m["workloads"]
    names = F.array_sort(F.coalesce(F.map_keys(loads), F.array().cast("array<string>")))
    own = loads["background_work"]
    seen = own["registered_observations"]["in_flight_deliveries_while_two_held"]
    rule = lambda ok, said: F.when(~F.coalesce(ok, F.lit(False)), F.array(F.lit(said))).otherwise(F.array().cast("array<string>"))
    budgets = lambda n: F.array_sort(F.coalesce(F.map_entries(loads[n]["budgets"]), F.array()))
    low = F.flatten(F.transform(names, lambda n: F.transform(F.filter(budgets(n), lambda b: ~F.coalesce(b["value"] > 0, F.lit(False))), lambda b: F.concat(F.lit("budget "), n, F.lit("."), b["key"], F.lit(" must be positive")))))
    bare = F.transform(F.filter(names, lambda n: loads[n]["budgets"].isNull()), lambda n: F.concat(F.lit("workload "), n, F.lit(" has no budgets")))
    rules = F.concat(
        rule(m["schema_version"] == 1, "schema_version must be 1"),
        rule(F.array_contains(names, "background_work") & F.array_contains(names, "events_replay"), "background_work and events_replay are required"),
        bare, low,
        rule(seen["metric"] == metric, f"the observation must use {metric}"),
        rule(seen["held_delivery_count"] == 2, "exactly two deliveries must be held"),
        rule(seen["expected_metric_value"] == seen["held_delivery_count"], "the expected value must equal the held count"),
        rule(own["messages"] >= seen["held_delivery_count"], "too few messages"),
        rule(F.trim(seen["scope"]) != "", "the observation has no scope"),
    )
    return manifests.select("*", F.explode(rules).alias("violation"))


def size_bytes(text: Column) -> Column:
    """Bytes of sizes such as 12.3MiB or 5kB; null if the text is no size."""
    number = F.nullif(F.regexp_extract(text, r"^\s*([0-9.]+)\s*[A-Za-z]*", 1), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"^\s*[0-9.]+\s*([A-Za-z]*)", 1))
    factor = F.when(unit.isin("", "b"), 1.0)
    for k, (si, binary) in enumerate((("kb", "kib"), ("mb", "mib"), ("gb", "gib"), ("tb", "tib")), 1):
        factor = factor.when(unit == si, float(1000**k)).when(unit == binary, float(1024**k))
    return number * factor


def cpu_seconds(lines: DataFrame) -> DataFrame:
    """One row: CPU seconds of a cgroup file, from usage_usec (version 2) or a bare number of ns (version 1)."""
    micro = F.max(F.regexp_extract("value", r"^usage_usec\s+([0-9]+)", 1).try_cast("double"))
    nano = F.max(F.regexp_extract("value", r"^\s*([0-9]+)\s*$", 1).try_cast("double"))
    return lines.agg(F.coalesce(micro / 1e6, nano / 1e9).alias("cpu_seconds"))
