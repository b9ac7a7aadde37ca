"""Operation metrics, resource samples, errors, accuracy reports and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import scan

#: Ranges of a group's values that are counted before the one with a wanted rank is put in order.
RANGES = 4096


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are equal, with the key columns once."""
    if not on:
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on], how).drop(*[f"_r_{c}" for c in on])


def index_percentiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """(group, share, value): the values at index floor(share * n) of each group's sorted values, not interpolated.

    A group may be most of the table, so it is never sorted as a whole: its values are
    counted in RANGES ranges, and only the ranges that hold a wanted rank are ranked.
    """
    df = df.where(F.col(value).isNotNull())
    stats = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    part = F.least(F.lit(RANGES - 1), F.coalesce(F.floor(F.try_divide((F.col(value) - F.col("_lo")) * RANGES, F.col("_hi") - F.col("_lo"))), F.lit(0))).cast("int")
    dealt = joined(df.select(*group, value), stats, group).withColumn("_b", part)
    w = Window.partitionBy(*group).orderBy("_b")
    counts = dealt.groupBy(*group, "_b", "_n").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
    share = F.explode(F.array(*map(F.lit, shares))).alias("share")
    want = counts.select("*", share).withColumn("_want", F.least(F.floor(F.col("_n") * F.col("share")), F.col("_n") - 1))
    want = want.where((F.col("_want") >= F.col("_before")) & (F.col("_want") < F.col("_before") + F.col("_c"))).select(*group, "_b", "share", (F.col("_want") - F.col("_before") + 1).alias("_at"))
    rank = F.row_number().over(Window.partitionBy(*group, "share").orderBy(value))
    return joined(dealt.select(*group, "_b", value), want, [*group, "_b"]).withColumn("_rank", rank).where("_rank = _at").select(*group, "share", F.col(value).alias("value"))


def index_percentile(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """(group, value) of one share."""
    return index_percentiles(df, group, value, [share]).drop("share")


def latency_summary(df: DataFrame, group: list[str], value: str, success: Column) -> DataFrame:
    """Counts, success rate, extremes, mean and index-based p50 and p95 of each group."""
    df = df.withColumn("_ok", success.cast("long"))
    sums = df.groupBy(*group).agg(
        F.count("*").alias("total_operations"),
        F.sum("_ok").alias("success_count"),
        (F.count("*") - F.sum("_ok")).alias("error_count"),
        F.avg("_ok").alias("success_rate"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("avg_value"),
    )
    p = index_percentiles(df, group, value, [0.5, 0.95])
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    return joined(sums, p.groupBy(*group).agg(at(0.5).alias("p50_value"), at(0.95).alias("p95_value")), group, "left")


def run_statistics(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Min, max, mean, median and deviation, as a benchmark runner reports them."""
    return df.groupBy(*group).agg(
        F.count("*").alias("n_runs"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"),
        F.median(value).alias("median_value"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev_value"),
    )


def is_regression(mean: Column, baseline: Column, factor: float = 1.5) -> Column:
    return mean > baseline * factor


def leak(df: DataFrame, group: list[str], order: list[str], value: str, limit: float = 100.0, rows_per_range: int | None = None) -> DataFrame:
    """Mean of the last five samples against the five before, at every row; null before the tenth."""
    rows = scan.running(df, group, order, value=F.col(value), keep=10, rows_per_range=rows_per_range)

    def mean(first: int) -> Column:
        part = F.filter(F.slice("tail", first, 5), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), F.size(part))

    df = rows.withColumn("increase", F.when(F.size("tail") == 10, mean(6) - mean(1))).drop("after", "tail")
    return df.withColumn("leak_detected", F.col("increase") > limit)


def growth(df: DataFrame, group: list[str], order: list[str], value: str, limit: float) -> DataFrame:
    """Does a series rise in more than 80 % of its steps and by more than ``limit`` in all?"""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumns({"_up": (F.col(value) > F.lag(value).over(w)).cast("double"), "_o": F.row_number().over(w)})
    out = rows.groupBy(*group).agg(F.avg("_up").alias("rising_share"), (F.max_by(value, "_o") - F.min_by(value, "_o")).alias("total_growth"))
    return out.withColumn("leaking", F.coalesce((F.col("rising_share") > 0.8) & (F.col("total_growth") > limit), F.lit(False)))


def health(error_rate: Column, memory_percent: Column) -> Column:
    """Later conditions override earlier ones."""
    return F.when(memory_percent > 95, "critical").when(memory_percent > 90, "warning").when(error_rate > 0.5, "degraded").otherwise("healthy")


def memory_status(percent: Column, used_mb: Column, max_gb: float = 8.0) -> Column:
    return F.when((percent >= 85) | (used_mb > max_gb * 1024), "critical").when(percent >= 70, "warning").otherwise("ok")


def recent_failures(df: DataFrame, failed: Column, order: list[str], n: int = 10) -> DataFrame:
    """The last n failures, oldest first."""
    return df.where(failed).orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def decayed(df: DataFrame, group: list[str], order: list[str], failed: str, rows_per_range: int | None = None) -> DataFrame:
    """Error rate after each group's rows in order: +1 for a failure, x 0.9 for a success."""
    bad = F.coalesce(F.col(failed), F.lit(False))
    rows = scan.running(df.select(*group, *order, bad.alias("_f")), group, order, F.when(F.col("_f"), 1.0).otherwise(0.9), F.when(F.col("_f"), 1.0).otherwise(0.0), rows_per_range=rows_per_range)
    # Of rows that share a place in the order, failures come last.
    return rows.groupBy(*group).agg(F.max_by("after", F.struct(*order, "_f")).alias("error_rate"))


# Errors.

#: Terms -> category, severity, retryable, strategy, recovery seconds, in order; the first that holds wins (fixed values).
ERROR_RULES = [
    (["timeout"], "timeout", "medium", True, "exponential_backoff", 30.0),
    (["network", "connection", "dns"], "transient_network", "medium", True, "exponential_backoff", 10.0),
    (["rate.limit", "too.many.requests", "429"], "rate_limit", "high", True, "linear_backoff", 60.0),
    (["auth", "unauthorized", "forbidden", "401", "403"], "authentication", "critical", False, None, None),
    (["out.of.memory", "memory", "oom"], "resource_exhausted", "high", True, "graceful_degradation", 120.0),
    (["model.failed", "inference.error", "vision.error"], "model_failure", "high", True, "model_fallback", 15.0),
    (["validation", "schema", "type.error"], "validation_error", "medium", False, "data_correction", None),
    (["config", "configuration", "setup"], "configuration_error", "high", False, None, None),
]
UNKNOWN = (None, "unknown", "medium", True, "exponential_backoff", None)


def classify(message: Column, type_name: Column) -> Column:
    """Struct of an error's handling. Terms are literal text, not patterns."""
    text, kind = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(type_name, F.lit("")))

    def handling(r: tuple) -> Column:
        return F.struct(
            F.lit(r[1]).alias("category"), F.lit(r[2]).alias("severity"), F.lit(r[3]).alias("is_retryable"),
            F.lit(r[4]).cast("string").alias("strategy"), F.lit(r[5]).cast("double").alias("recovery_seconds"),
        )

    out = handling(UNKNOWN)
    for r in reversed(ERROR_RULES):
        hit = F.lit(False)
        for term in r[0]:
            hit = hit | text.contains(term) | kind.contains(term)
        out = F.when(hit, handling(r)).otherwise(out)
    return out


def retry_delay(strategy: Column, attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0, recovery: Column | None = None) -> Column:
    """Seconds before the next attempt, without jitter; at least half the recovery time, if known."""
    delay = F.when(strategy == "fixed_delay", base).when(strategy == "linear_backoff", base * attempt).when(strategy == "exponential_backoff", base * F.pow(F.lit(factor), attempt - 1)).otherwise(base)
    delay = F.least(delay, F.lit(most))
    if recovery is not None:
        delay = F.greatest(delay, F.coalesce(recovery * 0.5, F.lit(0.0)))
    return F.when(strategy.isin("no_retry", "immediate"), 0.0).otherwise(F.greatest(F.lit(0.0), delay))


def degradation(strategy: Column, message: Column) -> Column:
    """What is returned in place of a failed result."""
    known = strategy.isin("graceful_degradation", "model_fallback", "data_correction", "partial_processing")
    return F.struct(
        F.coalesce(strategy.isin("model_fallback", "data_correction", "partial_processing"), F.lit(False)).alias("success"),
        F.lit(True).alias("partial_result"),
        F.when(known, strategy).otherwise("default").alias("degradation_applied"),
        message.alias("error_message"),
    )


def due(actions: DataFrame, as_of: Column) -> DataFrame:
    """Scheduled recovery actions whose time has come."""
    return actions.where(F.col("execute_at") <= as_of)


# Accuracy.


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, group: list[str], actual: Column, predicted: Column) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy; 0 where a denominator is."""
    n = lambda c: F.sum(c.cast("long"))
    out = df.groupBy(*group).agg(n(actual & predicted).alias("tp"), n(~actual & predicted).alias("fp"), n(actual & ~predicted).alias("fn"), n(~actual & ~predicted).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))


def document_score(success: Column, expected: Column, got: Column, quality: Column, metadata: Column) -> Column:
    """0.4 conversion, 0.3 page accuracy, 0.2 image quality, 0.1 metadata."""
    pages = F.coalesce(F.try_divide(F.least(expected, got).cast("double"), F.greatest(expected, got).cast("double")), F.lit(0.0))
    return 0.4 * success.cast("double") + 0.3 * pages + 0.2 * F.coalesce(quality, F.lit(0.0)) + 0.1 * F.coalesce(metadata, F.lit(0.0))


def accuracy_report(df: DataFrame, group: list[str]) -> DataFrame:
    """By category: a success with the right pages is a true positive, with wrong ones a false positive, a failure a false negative."""
    n = lambda c: F.sum(c.cast("long"))
    ok, match = F.col("conversion_success"), F.col("page_count_match")
    out = df.groupBy(*group).agg(n(ok & match).alias("tp"), n(ok & ~match).alias("fp"), n(~ok).alias("fn"), F.avg("overall_score").alias("mean_score"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))


def score_regressions(current: DataFrame, baseline: DataFrame, key: str, factor: float = 0.9) -> DataFrame:
    """Keys whose score fell below ``factor`` of the baseline."""
    met = current.join(baseline.select(key, F.col("score").alias("baseline_score")), key)
    return met.where(F.col("score") < F.col("baseline_score") * factor)


# Models.

#: name, capability, rank, most images, cost of 1000 tokens, image factor, batch, good for documents, fallback (fixed values).
MODELS = [
    ("CustomGPT5", "multimodal", 3, 10, 0.030, 2.0, True, True, "CustomOpus4"),
    ("CustomGPT5Mini", "advanced_vision", 2, 5, 0.005, 1.5, False, True, "CustomSonnet4"),
    ("CustomOpus4", "multimodal", 3, 8, 0.025, 1.8, True, True, "CustomSonnet4"),
    ("CustomSonnet4", "advanced_vision", 2, 6, 0.015, 1.6, True, True, "CustomHaiku"),
    ("CustomHaiku", "basic_vision", 1, 4, 0.003, 1.2, False, False, None),
]
NEEDED_RANK = {"simple": 1, "moderate": 2, "complex": 3, "advanced": 3}
IMAGE_FORMATS = ["jpg", "jpeg", "png", "gif", "webp"]


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MODELS, "client string, capability string, capability_rank int, max_images int, cost double, image_factor double, batch boolean, for_documents boolean, fallback string"
    )


def needed_rank(complexity: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in NEEDED_RANK.items() for x in kv]), complexity)


def cost(base: Column, factor: Column, images: Column) -> Column:
    return base + base * factor * images


def suitable(requests: DataFrame, specs: DataFrame) -> DataFrame:
    """Requests (images, complexity) with the models that can serve them. The model table is a handful of rows."""
    met = requests.join(F.broadcast(specs), F.col("images") <= F.col("max_images"))
    return met.where(F.col("capability_rank") >= needed_rank(F.col("complexity"))).withColumn("estimated_cost", cost(F.col("cost"), F.col("image_factor"), F.col("images")))


def cheapest(options: DataFrame, key: list[str]) -> DataFrame:
    return options.groupBy(*key).agg(F.min_by("client", F.struct("estimated_cost", "client")).alias("cheapest"), F.max_by("client", F.struct(value_score(), "client")).alias("best_value"))


def value_score() -> Column:
    return 1.0 / (F.col("estimated_cost") + 0.001) * F.when(F.col("for_documents"), 1.2).otherwise(1.0)


def fallback_chains(specs: DataFrame) -> DataFrame:
    """(client, step, fallback): the chain of each model. Five rows, so three self-joins at most."""
    step = specs.select("client", F.lit(1).alias("step"), "fallback").where("fallback is not null")
    out, hop = step, specs.select(F.col("client").alias("_c"), F.col("fallback").alias("_f")).where("fallback is not null")
    for n in range(2, 5):
        step = step.join(F.broadcast(hop), F.col("fallback") == F.col("_c")).select("client", F.lit(n).alias("step"), F.col("_f").alias("fallback"))
        out = out.unionByName(step)
    return out


def image_issues(image: Column) -> Column:
    """What is wrong with an image given as a data URI or a file name."""
    uri = image.startswith("data:image/")
    form = F.when(uri, F.regexp_extract(image, r"^data:image/([^;,]*)", 1)).otherwise(F.lower(F.regexp_extract(image, r"\.([^./]*)$", 1)))
    return F.array_compact(
        F.array(
            F.when(image.isNull(), F.lit("Image is None")),
            F.when(~form.isin(*IMAGE_FORMATS), F.concat(F.when(uri, "Unsupported format: ").otherwise("Unsupported file format: "), form)),
        )
    )


def inference_benchmark(df: DataFrame, group: list[str]) -> DataFrame:
    """Cold, mean warm and batch seconds of runs (kind, seconds, images): images a second and the batch's gain."""
    cold = F.avg(F.when(F.col("kind") == "cold", F.col("seconds")))
    warm = F.avg(F.when(F.col("kind") == "warm", F.col("seconds")))
    batch = F.sum(F.when(F.col("kind") == "batch", F.col("seconds"))) / F.sum(F.when(F.col("kind") == "batch", F.col("images")))
    out = df.groupBy(*group).agg(cold.alias("cold_seconds"), warm.alias("warm_seconds"), batch.alias("batch_seconds_per_image"))
    return out.withColumns({"images_per_second": F.try_divide(F.lit(1.0), "batch_seconds_per_image"), "batch_speedup": F.try_divide("warm_seconds", "batch_seconds_per_image")})


def same_confidence(fields: Column, value: Column) -> Column:
    """The same confidence for every field, as a map."""
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f, value)))


def suggested_client(complexity: Column, explicit: Column | None = None) -> Column:
    """The model for a complexity, or the one asked for."""
    by_level = {"simple": "CustomHaiku", "moderate": "CustomSonnet4", "complex": "CustomOpus4", "advanced": "CustomGPT5"}
    chosen = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in by_level.items() for x in kv]), complexity), F.lit("CustomSonnet4"))
    return chosen if explicit is None else F.coalesce(explicit, chosen)
