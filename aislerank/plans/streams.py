"""Queries that run the streaming jobs over everything available and read the result back.

A window or event stays open until the watermark passes it, so the statements compare what is closed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank.operators.interactions import validated
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.plans.measuring import CURRENT, GRADED, PSI, TVD, shifted
from aislerank.plans.merchandise import _ENGINE, _EV, DAY
from aislerank.plans.ranking import shelf
from aislerank.plans.sessions import FEW, GAP
from aislerank.session import scratch_path
from aislerank.streaming import jobs

HOUR = 3600000000
WATERMARK = f"wm AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - {HOUR} AS wm FROM events)"


def stream(spark, sf):
    event = F.col("event_type")
    return jobs.table_stream(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("session_id"),
        F.get_json_object("props", "$.k").alias("product_id"), "event_type",
        F.when(event == "click", "cart").when(event == "signup", "wishlist").otherwise(event).alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"))


@query("I1_stream_repeat_views", S.with_(FEW, WATERMARK) + f"""
, closed AS (SELECT few.* FROM few, wm WHERE us < wm),
flagged AS (SELECT *, event_type = 'view' AND coalesce(lag(product_id) OVER w = product_id AND lag(event_type) OVER w = 'view'
    AND us - lag(us) OVER w < {GAP * 1000000}, false) AS merged FROM closed WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
islands AS (SELECT *, sum(CASE WHEN merged THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY us, event_id) AS island FROM flagged),
merged AS (SELECT session_id, island, any_value(product_id) AS product_id, CASE WHEN count(*) > 1 THEN 'repeat_view' ELSE any_value(event_type) END AS event_type,
  max(us) AS us FROM islands GROUP BY session_id, island)
SELECT session_id, product_id, event_type, us FROM merged, wm
WHERE us + {GAP * 1000000} <= wm OR island < (SELECT max(island) FROM merged m WHERE m.session_id = merged.session_id)""")
def i1_stream(spark, sf):
    few = validated(stream(spark, sf).withColumn("event_type", F.col("kind"))).withColumn(
        "product_id", (F.col("product_id").cast("bigint") % 3).cast("string"))
    return jobs.run_once(jobs.repeat_views(few, GAP)).drop("batch")


@query("I2_stream_newest_events", """
SELECT user_id::VARCHAR AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS position FROM events QUALIFY position < 50""")
def i2_stream(spark, sf):
    rows = jobs.run_once(jobs.newest_events(stream(spark, sf)), "update")
    latest = rows.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["session_id", "batch"], "left_semi").drop("batch")


@query("L2_stream_windowed_trend", S.with_(_EV, WATERMARK) + f"""
, d AS (SELECT product_id, us, us // {DAY} * {DAY} AS window_start FROM ev),
s AS (SELECT window_start, product_id, count(*) AS events, {S.rnd(f'sum(pow(0.95, (window_start + {DAY} - us) / 3.6e9))', 6)} AS score FROM d GROUP BY ALL HAVING count(*) >= 3)
SELECT s.*, row_number() OVER (PARTITION BY window_start ORDER BY score DESC, product_id) AS rank FROM s, wm WHERE window_start + {DAY} <= wm QUALIFY rank <= 10""")
def l2_stream(spark, sf):
    rows = jobs.run_once(jobs.windowed_trend(stream(spark, sf), min_count=3), each=jobs.rank_windows(10))
    return rows.withColumn("rank", F.col("rank").cast("bigint")).drop("batch")


@query("L3_stream_click_through", S.with_(_EV, WATERMARK) + f"""
SELECT us // {DAY} * {DAY} AS window_start, {_ENGINE} AS engine, count(*) FILTER (WHERE event_type = 'view') AS impressions,
  count(*) FILTER (WHERE event_type = 'click') AS clicks, {S.rnd("count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'view')", 6)} AS ctr
FROM ev GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_type = 'view') >= 10 AND us // {DAY} * {DAY} + {DAY} <= (SELECT wm FROM wm)""")
def l3_stream(spark, sf):
    rest = F.col("product_id").cast("bigint") % 3
    named = stream(spark, sf).withColumn(
        "engine", F.when(rest == 0, "hybrid").when(rest == 1, "trending").otherwise("personalized"))
    return jobs.run_once(jobs.click_through(named)).drop("batch")


@query("L4_stream_conversions", S.with_(_EV) + f"""
, wm AS (SELECT least(max(us) FILTER (WHERE event_type = 'click'), max(us) FILTER (WHERE event_type = 'purchase')) // 1000 * 1000 - {HOUR} AS wm FROM ev)
SELECT c.event_id, c.session_id, c.us AS clicked_at, min(p.us) AS purchased_at FROM (SELECT * FROM ev WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p ON p.session_id = c.session_id AND p.us >= c.us AND p.us <= c.us + 43200000000
WHERE c.us < (SELECT wm FROM wm) - 43200000000 GROUP BY ALL""")
def l4_stream(spark, sf):
    return jobs.run_once(jobs.conversions(stream(spark, sf), 720)).drop("batch")


@query("D5_stream_drift", S.with_(S.FEATURES, CURRENT, PSI, TVD, GRADED) + "SELECT 'compared' AS status, feature, metric, value, grade FROM graded")
def d5_stream(spark, sf):
    """A stored baseline, then the shifted catalogue arriving as a stream of files."""
    from aislerank.operators import drift

    base = scratch_path(spark, "drift-stream")
    df = shelf(spark, sf)
    drift.save_baseline(df, f"{base}/baseline")
    shifted(df).write.parquet(f"{base}/in/catalogue.parquet")
    arriving = (spark.readStream.schema(spark.read.parquet(f"{base}/in/catalogue.parquet").schema)
                .parquet(f"{base}/in/catalogue.parquet"))
    return jobs.run_once(arriving, each=jobs.check_drift(f"{base}/baseline")).drop("batch")
