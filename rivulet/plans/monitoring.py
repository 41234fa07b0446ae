"""Metric-log and data-quality queries (``events`` as the training metrics
log: event_type = run, event_id = step, value = loss; ``documents``)."""
from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.text import json_quote
from rivulet.operators import evaluate, quality
from rivulet.plans.registry import register
from rivulet.sources.tables import table

STEPS_PER_EPOCH = 1000
BLOCK = 100


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"),
                    F.floor(F.col("event_id") / STEPS_PER_EPOCH).cast("long").alias("epoch"),
                    F.col("value").alias("loss"), (F.col("value") < 20).alias("correct"))


@register("metrics_rollup", """
SELECT event_type AS run, CAST(floor(event_id / 1000) AS BIGINT) AS epoch,
       CAST(floor(event_id / 100) AS BIGINT) AS block, count(*) AS n_steps,
       round(avg(value), 4) AS mean_loss, CAST(count_if(value < 20) AS BIGINT) AS n_correct,
       round(count_if(value < 20) / count(*), 4) AS accuracy
FROM events GROUP BY ALL
""")
def metrics_rollup(spark, sf_dir):
    """Per run / epoch / block of 100 steps: mean loss and accuracy."""
    return evaluate.metrics_rollup(_log(spark, sf_dir), block=BLOCK)


@register("best_checkpoint", """
WITH s AS (SELECT event_type AS run, CAST(floor(event_id / 1000) AS BIGINT) AS epoch,
                  round(avg(value), 4) AS score FROM events GROUP BY ALL),
p AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM s),
f AS (SELECT *, prev_best IS NULL OR score > prev_best AS is_best,
             prev_best IS NOT NULL AND score < prev_best AS below FROM p),
g AS (SELECT *, sum(CASE WHEN below THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM f),
st AS (SELECT *, CAST(sum(CASE WHEN below THEN 1 ELSE 0 END) OVER (PARTITION BY run, grp ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS below_streak FROM g)
SELECT run, epoch, score, greatest(coalesce(prev_best, score), score) AS best_score, is_best, below_streak,
       max(CASE WHEN below_streak >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS stopped
FROM st
""")
def best_checkpoint(spark, sf_dir):
    """A13 + Q4: epoch score = mean value; strict improvements mark the best
    checkpoint; early stop after 2 consecutive epochs below the best."""
    s = (_log(spark, sf_dir).groupBy("run", "epoch")
         .agg(F.round(F.avg("loss"), 4).alias("score")))
    return evaluate.best_so_far(s, patience=2)


@register("quality_checks", """
SELECT count(*) AS n_rows,
       CAST(count_if(contains(source, chr(9))) AS BIGINT) AS bad_tab_in_title,
       CAST(count_if(contains(replace(to_json(text), '\t', ''), chr(9))) AS BIGINT) AS bad_tab_in_text,
       CAST(count_if(doc_id IS NULL) AS BIGINT) AS bad_null_id,
       CAST(count_if(n_chars <> length(text)) AS BIGINT) AS bad_length_mismatch
FROM documents
""")
def quality_checks(spark, sf_dir):
    """F15 + F16: TSV tab guard on title / JSON-quoted text, id not null,
    declared length equals the text length -- violation counts."""
    d = table(spark, sf_dir, "documents").withColumn("qtext", json_quote("text"))
    rules = {"tab_in_title": F.col("source").contains("\t"),
             "tab_in_text": F.col("qtext").contains("\t"),
             "null_id": F.col("doc_id").isNull(),
             "length_mismatch": F.col("n_chars") != F.length("text")}
    return quality.check(d, rules)
