"""Trend and snapshot operators as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.functions import scalars as S
from topicpulse.operators import library as L
from topicpulse.operators import trends as T
from topicpulse.plans.adapters_sql import register_cte
from topicpulse.plans.library import AS_OF
from topicpulse.plans.registry import query
from topicpulse.sources.tables import SampleStore as Store

_RATE = "CASE WHEN old = 0 THEN CASE WHEN new > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (new - old) / old END"

register_cte(
    "labelled",
    f"""SELECT d.id, d.title, d.category, d.first_seen, d.importance_score, d.trend AS old_trend, c.frequency AS cur, p.frequency AS prev,
      CASE WHEN c.frequency IS NOT NULL AND p.frequency IS NULL THEN 'new'
           WHEN c.frequency IS NULL THEN NULL
           WHEN (c.frequency - p.frequency) / p.frequency > 0.2 THEN 'rising'
           WHEN (c.frequency - p.frequency) / p.frequency < -0.2 THEN 'declining' ELSE 'stable' END AS change
      FROM demands d
      LEFT JOIN (SELECT * FROM trend_snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM trend_snapshots)) c ON c.demand_id = d.id
      LEFT JOIN (SELECT * FROM trend_snapshots WHERE snapshot_date = (SELECT DISTINCT snapshot_date FROM trend_snapshots ORDER BY 1 DESC LIMIT 1 OFFSET 1)) p
        ON p.demand_id = d.id""",
)


def labelled(s: Store) -> DataFrame:
    return T.detect_trends(s.demands, s.trend_snapshots)


@query(
    "agg12_trend_snapshot",
    f"""SELECT id AS demand_id, CAST({AS_OF} AS DATE) AS snapshot_date, frequency, importance_score AS heat_score,
        CAST(epoch_us({AS_OF}) AS BIGINT) AS taken FROM demands""",
)
def trend_snapshot(s: Store) -> DataFrame:
    return T.create_snapshot(s.demands, s.as_of)


@query(
    "snk07_snapshot_append",
    f"""SELECT snapshot_date, count(*) AS n, CAST(sum(frequency) AS BIGINT) AS frequency FROM
        (SELECT snapshot_date, frequency FROM trend_snapshots UNION ALL SELECT CAST({AS_OF} AS DATE), frequency FROM demands) GROUP BY 1""",
)
def snapshot_append(s: Store) -> DataFrame:
    """The history after one more snapshot, read back from its dated folders."""
    from topicpulse.session import new_folder

    path = new_folder(s.spark, "snapshots")
    T.append_snapshot(s.trend_snapshots, path)
    T.append_snapshot(T.create_snapshot(s.demands, s.as_of), path)
    history = s.spark.read.parquet(path)
    return history.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"), F.sum("frequency").alias("frequency"))


@query("agg13_trend_summary", "SELECT change, count(*) AS demands FROM labelled WHERE change IS NOT NULL GROUP BY 1")
def trend_summary(s: Store) -> DataFrame:
    return T.trend_summary(labelled(s))


@query(
    "trd01_change_rate",
    f"""SELECT id, {_RATE} AS rate FROM (SELECT id, frequency % 4 AS old, (id % 5)::BIGINT AS new FROM demands)""",
)
def change_rate(s: Store) -> DataFrame:
    return s.demands.select("id", T.change_rate(F.col("frequency") % 4, F.col("id") % 5).alias("rate"))


@query(
    "trd02_detect_trends",
    """SELECT id, title, change, CASE WHEN change = 'new' THEN 'rising' ELSE coalesce(change, old_trend) END AS trend,
       cur AS current_frequency, prev AS previous_frequency FROM labelled""",
)
def detect_trends(s: Store) -> DataFrame:
    return labelled(s).select("id", "title", "change", "trend", "current_frequency", "previous_frequency")


_RETAKEN = "SELECT demand_id, snapshot_date, 1 + frequency * (demand_id % 4) // 2 AS frequency, taken + 1 + demand_id % 3 AS taken FROM trend_snapshots WHERE demand_id % 2 = 0"


@query(
    "trd02_last_of_the_day",
    f"""SELECT d.id, c.frequency AS current_frequency, p.frequency AS previous_frequency FROM demands d
        LEFT JOIN (SELECT * FROM last_rows WHERE back = 1) c ON c.demand_id = d.id LEFT JOIN (SELECT * FROM last_rows WHERE back = 2) p ON p.demand_id = d.id""".replace(
        "last_rows",
        f"""(SELECT demand_id, arg_max(frequency, taken) AS frequency, any_value(b) AS back FROM
             (SELECT *, dense_rank() OVER (ORDER BY snapshot_date DESC) AS b FROM
              (SELECT demand_id, snapshot_date, frequency, taken FROM trend_snapshots UNION ALL {_RETAKEN})) GROUP BY demand_id, b)""",
    ),
)
def last_of_the_day(s: Store) -> DataFrame:
    """Half of the demands were snapshot twice on every date; the later one counts."""
    columns = ["demand_id", "snapshot_date", "frequency", "taken"]
    demand = F.col("demand_id")
    again = s.trend_snapshots.where(demand % 2 == 0).select(
        "demand_id",
        "snapshot_date",
        (1 + F.floor(F.col("frequency") * (demand % 4) / 2)).alias("frequency"),
        (F.col("taken") + 1 + demand % 3).alias("taken"),
    )
    rows = T.detect_trends(s.demands, s.trend_snapshots.select(columns).unionByName(again))
    return rows.select("id", "current_frequency", "previous_frequency")


@query(
    "joi07_snapshot_compare",
    """SELECT c.demand_id, c.frequency AS current_frequency, p.frequency AS previous_frequency FROM
       (SELECT * FROM trend_snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM trend_snapshots)) c LEFT JOIN
       (SELECT * FROM trend_snapshots WHERE snapshot_date = (SELECT DISTINCT snapshot_date FROM trend_snapshots ORDER BY 1 DESC LIMIT 1 OFFSET 1)) p USING (demand_id)""",
)
def snapshot_compare(s: Store) -> DataFrame:
    rows = labelled(s).where("current_frequency IS NOT NULL")
    return rows.select(F.col("id").alias("demand_id"), "current_frequency", "previous_frequency")


@query(
    "trd03_trend_history",
    """SELECT demand_id, snapshot_date, frequency, row_number() OVER (PARTITION BY demand_id ORDER BY snapshot_date) AS position FROM
       (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY snapshot_date DESC) AS b FROM trend_snapshots) WHERE b <= 4""",
)
def trend_history(s: Store) -> DataFrame:
    return T.trend_history(s.trend_snapshots, 4).select("demand_id", "snapshot_date", "frequency", "position")


@query(
    "trd04_trend_series",
    """SELECT t.demand_id, coalesce(any_value(d.title), concat('Demand #', t.demand_id)) AS title, count(*) AS n_points,
       string_agg(concat(t.snapshot_date, ':', t.frequency, ':', CAST(t.heat_score AS DECIMAL(18, 2))), ',' ORDER BY t.snapshot_date) AS data
       FROM trend_snapshots t LEFT JOIN demands d ON d.id = t.demand_id
       WHERE t.snapshot_date >= DATE '2001-03-01' - 12 * 7 GROUP BY t.demand_id""",
)
def trend_series(s: Store) -> DataFrame:
    as_of = F.lit("2001-03-01").cast("date")
    return T.trend_series(s.trend_snapshots, s.demands, as_of)


@query(
    "trd05_trend_matrix",
    """SELECT g.snapshot_date, b.id AS demand_id, coalesce(t.frequency, 0) AS value
       FROM (SELECT DISTINCT snapshot_date FROM trend_snapshots) g
       CROSS JOIN (SELECT id FROM demands ORDER BY frequency DESC, id LIMIT 10) b
       LEFT JOIN trend_snapshots t ON t.demand_id = b.id AND t.snapshot_date = g.snapshot_date""",
)
def trend_matrix(s: Store) -> DataFrame:
    return T.trend_matrix(s.trend_snapshots, s.demands)


@query(
    "trd06_all_period_changes",
    """SELECT *, CASE WHEN rate > 0.2 THEN 'rising' WHEN rate < -0.2 THEN 'declining' ELSE 'stable' END AS label FROM
       (SELECT demand_id, snapshot_date, previous, frequency, round((frequency - previous) / previous, 6) AS rate FROM
        (SELECT *, lag(frequency) OVER (PARTITION BY demand_id ORDER BY snapshot_date) AS previous FROM trend_snapshots)
        WHERE previous IS NOT NULL)""",
)
def all_period_changes(s: Store) -> DataFrame:
    return T.all_period_changes(s.trend_snapshots)


@query(
    "ext09_trend_facts",
    f"""SELECT change AS class, id, title FROM labelled WHERE change IS NOT NULL UNION ALL
        SELECT 'emerging', id, title FROM demands WHERE first_seen >= {AS_OF} - INTERVAL 7 DAY AND importance_score > 5""",
)
def trend_facts(s: Store) -> DataFrame:
    return T.trend_facts(labelled(s), L.emerging(s.demands, s.as_of))


@query(
    "demand_weekly_pulse",
    f"""SELECT * FROM (SELECT category, id, title, change, current_frequency, rate, emerging,
          row_number() OVER (PARTITION BY category ORDER BY current_frequency DESC, id) AS rank FROM
        (SELECT coalesce(nullif(category, ''), '未分类') AS category, id, title, change, cur AS current_frequency,
           round((cur - prev) / prev, 6) AS rate, first_seen >= {AS_OF} - INTERVAL 7 DAY AND importance_score > 5 AS emerging
         FROM labelled WHERE change IN ('rising', 'new'))) WHERE rank <= 5""",
)
def weekly_pulse(s: Store) -> DataFrame:
    return T.weekly_pulse(s.demands, s.trend_snapshots, s.as_of)
