"""Per-period totals corrected as late records arrive. SQL only.

The triangle of event periods by arrival periods: every counted publication
becomes a change of its period's total at its time of arrival (new value less
the one it replaces), the changes are added by (period, arrival period) cell and
the cells cumulated across arrivals. Each cumulated cell is a revision. Arrival
period 0 holds all that came by the end of the period's day; what comes after
the cut-off is filtered out before anything is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

TRIANGLE = """
WITH once AS (  -- a repeat counts from its first arrival
  SELECT snapshot_id, min(arrived_at) AS arrived_at,
         min_by(struct(series, instrument_id, snapshot_time, lower(trim(snapshot_type)) AS type, open_interest AS oi),
                struct(arrived_at, open_interest)) AS p
  FROM {pubs}
  WHERE snapshot_id IS NOT NULL AND arrived_at IS NOT NULL
  GROUP BY snapshot_id
), placed AS (
  SELECT p.series AS series, to_date(p.snapshot_time) AS day, p.type AS snapshot_type, p.instrument_id AS instrument_id,
         struct(p.snapshot_time AS at, snapshot_id AS id, CAST(p.oi AS BIGINT) AS oi) AS pub,
         unix_micros(arrived_at) - unix_micros(CAST(date_add(to_date(p.snapshot_time), 1) AS TIMESTAMP)) AS late_us, arrived_at
  FROM once
  WHERE p.snapshot_time IS NOT NULL AND p.oi IS NOT NULL AND p.type IN ('evening', 'morning')
), counted AS (
  SELECT *, CASE WHEN late_us <= 0 THEN 0 ELSE (late_us + {step_us} - 1) DIV {step_us} END AS arrival
  FROM placed WHERE late_us <= {cutoff_us}
), winners AS (  -- the publication that holds for the contract after each arrival
  SELECT *, max(pub) OVER (PARTITION BY series, day, snapshot_type, instrument_id ORDER BY arrived_at, pub
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held
  FROM counted
), changes AS (
  SELECT series, day, snapshot_type, arrival,
         held.oi - coalesce(lag(held.oi) OVER (PARTITION BY series, day, snapshot_type, instrument_id ORDER BY arrived_at, pub), 0) AS change
  FROM winners
), cells AS (
  SELECT series, day, snapshot_type, arrival, sum(change) AS change, count(*) AS publications
  FROM changes GROUP BY series, day, snapshot_type, arrival
)
SELECT series, day, snapshot_type, arrival,
       CAST(sum(change) OVER (PARTITION BY series, day, snapshot_type ORDER BY arrival) AS BIGINT) AS oi_total,
       CAST(sum(publications) OVER (PARTITION BY series, day, snapshot_type ORDER BY arrival) AS BIGINT) AS publications
FROM cells
"""

CORRECTED = """
SELECT series, date_format(day, 'yyyy-MM-dd') AS day, snapshot_type, final AS oi_total
FROM (
  SELECT series, day, snapshot_type, max_by(oi_total, arrival) AS final,
         max(CASE WHEN arrival = 0 THEN oi_total END) AS on_time
  FROM {revisions} GROUP BY series, day, snapshot_type
) WHERE on_time IS NULL OR final <> on_time
"""


def revisions(pubs: DataFrame, cutoff_hours: int = 36, step_seconds: int = 3600) -> DataFrame:
    """series, day, snapshot_type, arrival, oi_total, publications: every revision of every period.

    arrival is the period of step_seconds after the end of the day in which the
    revision came (0: by midnight); what comes within one period is one revision. Publications without id, times, known type or value do
    not count, nor do those that arrive after cutoff_hours. A null series or
    instrument is one of its own. An empty table has no revisions.
    """
    return pubs.sparkSession.sql(TRIANGLE.replace("{cutoff_us}", str(cutoff_hours * 3_600_000_000)).replace("{step_us}", str(step_seconds * 1_000_000)), pubs=pubs)


def corrected(pubs: DataFrame, cutoff_hours: int = 36) -> DataFrame:
    """The periods whose final total differs from the one on time, or that had none, with the final total."""
    return pubs.sparkSession.sql(CORRECTED, revisions=revisions(pubs, cutoff_hours))
