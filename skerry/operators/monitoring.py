"""Search history, logs, latency alerts and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WARN_MS, ERROR_MS, TAIL = 2000, 5000, 20


def alert_level(mean: Column) -> Column:
    return F.when(mean > ERROR_MS, "error").when(mean > WARN_MS, "warning").otherwise("ok")


def search_history(history: DataFrame, projects: DataFrame, n: int = 20) -> DataFrame:
    """The last n searches of each user, with the project's name if there is one."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    last = history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    return last.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left")


def log_searches(queries: DataFrame, results: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(history rows, log rows) of a batch: queries without results are logged with none."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = queries.join(counts, "query_id", "left").withColumn("result_count", F.coalesce("_n", F.lit(0))).withColumn("created_at", F.lit(as_of).cast("timestamp_ntz"))
    history = rows.select("query_id", "user_id", F.col("text").alias("query_text"), "search_type", "result_count", "created_at")
    logs = rows.select("query_id", "user_id", F.sha2("text", 256).alias("query_hash"), "search_type", "result_count", "search_time_ms",
                       (F.col("result_count") > 0).alias("had_results"), "created_at")
    return history, logs


def search_latency_alert(logs: DataFrame, n: int = TAIL, key: str = "user_id") -> DataFrame:
    """After each search of a key: mean of its last n search times and the alert level."""
    w = Window.partitionBy(key).orderBy("created_at", "event_id").rowsBetween(-(n - 1), 0)
    mean = F.round(F.avg("search_time_ms").over(w), 6)
    return logs.select("event_id", key, mean.alias("mean_ms")).withColumn("level", alert_level(F.col("mean_ms")))


def embedding_costs(costs: DataFrame, users: DataFrame, as_of: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(totals: one row, users by spend) of the month up to as_of; the projection assumes the month goes on as it began."""
    now = F.lit(as_of).cast("timestamp_ntz")
    month = costs.filter((F.col("created_at") >= F.date_trunc("month", now)) & (F.col("created_at") <= now))
    total = F.coalesce(F.sum("cost_usd").cast("double"), F.lit(0.0))
    totals = month.agg(F.round(total, 8).alias("total_cost_usd"), F.round(F.coalesce(F.avg(F.col("cost_usd").cast("double")), F.lit(0.0)), 8).alias("mean_cost_usd"),
                       F.round(total / F.dayofmonth(now) * F.dayofmonth(F.last_day(now)), 6).alias("projected_cost_usd"))
    spend = month.join(users, "user_id").groupBy("user_id", "full_name", "email").agg(F.sum("cost_usd").cast("double").alias("total_cost_usd"))
    return totals, spend.orderBy(F.desc("total_cost_usd"), "user_id").limit(top)


def content_gaps(logs: DataFrame) -> DataFrame:
    """Query hashes that ever found nothing: how often asked, how often without results."""
    out = logs.groupBy("query_hash").agg(F.count(F.lit(1)).alias("searches"), F.count_if(~F.col("had_results")).alias("without_results"))
    return out.filter("without_results > 0")


def mode_comparison(logs: DataFrame) -> DataFrame:
    out = logs.groupBy("search_type").agg(
        F.count(F.lit(1)).alias("searches"), F.round(F.avg(F.col("had_results").cast("int")), 6).alias("hit_rate"), F.round(F.avg("result_count"), 6).alias("mean_results"),
        F.round(F.avg("search_time_ms"), 6).alias("mean_ms"), F.percentile("search_time_ms", 0.95).alias("p95_ms"))
    return out.withColumn("p95_ms", F.round("p95_ms", 6))


def answer_feedback(answers: DataFrame, logs: DataFrame) -> DataFrame:
    """Share of helpful answers by search type of the search behind them; answers without a rating do not count."""
    joined = answers.join(logs.select(F.col("event_id").alias("search_log_id"), "search_type"), "search_log_id", "left")
    return joined.groupBy("search_type").agg(F.count(F.lit(1)).alias("answers"), F.count("helpful").alias("rated"), F.round(F.avg(F.col("helpful").cast("int")), 6).alias("helpful_rate"))


def rate_answers(answers: DataFrame, ratings: DataFrame) -> DataFrame:
    """ratings (query_id, helpful) replace the old ones; the rest stays."""
    new = ratings.select("query_id", F.col("helpful").alias("_new"))
    return answers.join(new, "query_id", "left").withColumn("helpful", F.coalesce("_new", "helpful")).drop("_new")
