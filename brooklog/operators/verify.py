"""Schedules, case matrices, and checks of observed deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brooklog.operators.log import running_count


def case_matrix(spark: SparkSession, dimensions: dict[str, list], repetitions: int, most: int = 100_000) -> DataFrame:
    """All combinations of the dimensions' values, with repetition and case_id; dimensions are literals and so bounded."""
    total = repetitions
    for values in dimensions.values():
        total *= len(values)
    if total > most:
        raise ValueError(f"{total} cases, {most} at most")
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    for name, values in dimensions.items():
        rows = rows.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return rows.withColumn("case_id", F.concat_ws("-", *dimensions, F.format_string("%03d", "repetition")))


def scenario_matrix(spark: SparkSession, dimensions: dict[str, list], relevant: dict[str, list[str]], repetitions: int, most: int = 100_000) -> DataFrame:
    """case_matrix of each scenario: dimensions that aren't relevant to it keep their first value. relevant: scenario -> names of dimensions."""
    out = None
    total = 0
    for scenario, names in relevant.items():
        own = {d: values if d in names else values[:1] for d, values in dimensions.items()}
        cases = 1
        for values in own.values():
            cases *= len(values)
        total += cases * repetitions
        if total > most:
            raise ValueError(f"{total} cases, {most} at most")
        rows = case_matrix(spark, own, repetitions, most)
        rows = rows.select(F.lit(scenario).alias("scenario"), *dimensions, "repetition", F.concat_ws("-", F.lit(scenario), "case_id").alias("case_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def hot_cold_schedule(spark: SparkSession, hot: int = 64, cold_keys: int = 4, each: int = 8) -> DataFrame:
    """(offset, key): rounds of one hot record and then one of each cold key while these last."""
    rounds = spark.range(hot).select(F.col("id").alias("round"))
    place = F.explode(F.sequence(F.lit(0), F.lit(cold_keys))).alias("place")
    rows = rounds.select("round", place).filter((F.col("place") == 0) | (F.col("round") < each))
    offset = F.when(F.col("round") < each, F.col("round") * (cold_keys + 1) + F.col("place")).otherwise(each * (cold_keys + 1) + F.col("round") - each)
    return rows.select(offset.cast("long").alias("offset"), F.when(F.col("place") == 0, "hot").otherwise(F.concat(F.lit("cold-"), F.col("place").cast("string"))).alias("key"))


def per_key_ordering(deliveries: DataFrame, key: str, offset: str, delivered: str, completed: str) -> DataFrame:
    """(key, deliveries, out_of_order, most_in_flight): order of delivery, and overlap of delivery and completion."""
    w = Window.partitionBy(key).orderBy(delivered, offset)
    late = F.col(offset) < F.lag(offset).over(w)
    order = deliveries.withColumn("_late", late).groupBy(key).agg(F.count(F.lit(1)).alias("deliveries"), F.count_if("_late").alias("out_of_order"))
    steps = deliveries.select(key, F.inline(F.array(F.struct(F.col(delivered).alias("_t"), F.lit(1).alias("_d")), F.struct(F.col(completed).alias("_t"), F.lit(-1).alias("_d")))))
    run = Window.partitionBy(key).orderBy("_t", "_d").rowsBetween(Window.unboundedPreceding, 0)
    most = steps.withColumn("_in", F.sum("_d").over(run)).groupBy(key).agg(F.max("_in").alias("most_in_flight"))
    return order.join(most, key)


def hot_backlog(events: DataFrame, stream: str, seq: str, hot) -> DataFrame:
    """(stream, cold_while_hot, most_backlog): cold completions while hot ones are left, and the largest hot backlog, counted in spans of seq."""
    total = events.groupBy(F.col(stream).alias("_t")).agg(F.count_if(hot).alias("_total"))
    counted = running_count(events.withColumn("_hot", F.coalesce(hot, F.lit(False))), stream, seq, "_before", F.col("_hot"))
    left = counted.join(total, F.col(stream) == F.col("_t")).withColumn("_left", F.col("_total") - F.col("_before") - F.col("_hot").cast("int"))
    return left.groupBy(stream).agg(F.count_if(~F.col("_hot") & (F.col("_left") > 0)).alias("cold_while_hot"), F.max("_left").alias("most_backlog"))


def cold_fairness(events: DataFrame, stream: str, key: str, t: str) -> DataFrame:
    """(stream, keys, first_spread, last_spread): spread of the keys' first and last completion times."""
    each = events.groupBy(stream, key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    return each.groupBy(stream).agg(F.count(F.lit(1)).alias("keys"), (F.max("_a") - F.min("_a")).alias("first_spread"), (F.max("_b") - F.min("_b")).alias("last_spread"))


def matrix_status(cases: DataFrame, group: str, status: str) -> DataFrame:
    """(group, planned, attempted, completed, failed)."""
    s = F.col(status)
    return cases.groupBy(group).agg(F.count(F.lit(1)).alias("planned"), F.count_if(s != "planned").alias("attempted"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"))


def repeated_polls(polls: DataFrame) -> DataFrame:
    """(stream, polls, matching): repeated polls of a member that give the same offset and attempt as its first."""
    w = Window.partitionBy("stream", "member").orderBy("seq")
    first = F.first(F.struct("offset", "attempt")).over(w)
    own = polls.withColumn("_same", (F.row_number().over(w) > 1) & first.eqNullSafe(F.struct("offset", "attempt")))
    return own.groupBy("stream").agg(F.count(F.lit(1)).alias("polls"), F.count_if("_same").alias("matching"))


def rule_violations(rows: DataFrame, rules: dict) -> DataFrame:
    """All rows' columns with rule: one row for each rule (name -> condition) that doesn't hold; null fails."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select("*", F.explode(broken).alias("rule"))
