"""Thinned failure records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.catalogue.registry import query
from eventloom.catalogue.tables import FAIL, failures
from eventloom.operators import sampling

_CHANGE = f"""WITH {FAIL}, c AS (
  SELECT *, key IS DISTINCT FROM lag(key) OVER (PARTITION BY gate ORDER BY seq) AS admitted,
    row_number() OVER (PARTITION BY gate ORDER BY seq) AS n FROM fail)"""


@query(f"{_CHANGE} SELECT gate, seq, admitted FROM c")
def sample_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.on_change(failures(spark, sf_dir)).select("gate", "seq", "admitted")


@query(
    f"""{_CHANGE} SELECT gate, seq, n - coalesce(lag(n) OVER (PARTITION BY gate ORDER BY seq), 0) - 1 AS suppressed
    FROM c WHERE admitted"""
)
def sample_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = sampling.on_change(failures(spark, sf_dir), keep_segment=True)
    return sampling.with_suppressed(admitted).select("gate", "seq", "suppressed")


@query(
    f"""WITH {FAIL}, f AS (SELECT gate, key, min(seq) AS seq FROM fail GROUP BY gate, key),
    r AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY seq) AS n FROM f)
    SELECT gate, seq, key FROM r WHERE n <= 3"""
)
def sample_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_seen(failures(spark, sf_dir), 3).filter("admitted").select("gate", "seq", "key")


# At most two records of a kind per hour and gate, one by one.
INTERVAL_SQL = f"""WITH RECURSIVE {FAIL}, n AS (
      SELECT *, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY gate ORDER BY seq) AS rn FROM fail),
    w AS (
      SELECT gate, rn, seq, key, moment AS since, 1 AS count, true AS admitted FROM n WHERE rn = 1
      UNION ALL
      SELECT gate, n.rn, n.seq, n.key,
        CASE WHEN n.key <> w.key OR n.moment - since >= 3600000000 THEN n.moment ELSE since END,
        CASE WHEN n.key <> w.key OR n.moment - since >= 3600000000 THEN 1 ELSE least(count + 1, 3) END,
        n.key <> w.key OR n.moment - since >= 3600000000 OR count < 2
      FROM w JOIN n USING (gate) WHERE n.rn = w.rn + 1)"""


@query(f"{INTERVAL_SQL} SELECT gate, seq, admitted FROM w")
def sample_per_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two records of a kind per hour and gate."""
    thinned = sampling.per_interval(failures(spark, sf_dir), dt.timedelta(hours=1), 2)
    return thinned.select("gate", "seq", "admitted")


@query(
    f"""WITH {FAIL}, r AS (SELECT *, key = 'signup' AS recovered,
        coalesce(sum((key = 'signup')::INT) OVER (PARTITION BY gate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM fail),
      f AS (SELECT *, key IS DISTINCT FROM lag(key) OVER (PARTITION BY gate, run ORDER BY seq) AS admitted,
        row_number() OVER (PARTITION BY gate, run ORDER BY seq) AS n FROM r WHERE NOT recovered),
      ends AS (SELECT gate, run, max(n) - max(n) FILTER (WHERE admitted) AS withheld FROM f GROUP BY gate, run)
    SELECT gate, seq, key, n - coalesce(lag(n) OVER (PARTITION BY gate, run ORDER BY seq), 0) - 1 AS suppressed FROM f WHERE admitted
    UNION ALL SELECT gate, seq, 'recovered', withheld FROM r JOIN ends USING (gate, run) WHERE recovered"""
)
def sample_until_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures thinned run by run; sign-ups end the runs. Segments of 700 rows, so that runs cross them."""
    rows = failures(spark, sf_dir).withColumn("recovered", F.col("key") == "signup")
    found = sampling.until_recovered(rows, lambda run: sampling.on_change(run, span=700), span=700)
    return found.select("gate", "seq", F.when(F.col("recovered"), "recovered").otherwise(F.col("key")).alias("key"), "suppressed")


@query(
    f"""{_CHANGE}, m AS (SELECT gate, seq, n FROM c WHERE admitted)
    SELECT gate, seq, n - coalesce(lag(n) OVER (PARTITION BY gate ORDER BY seq), 0) - 1 AS suppressed FROM m"""
)
def sample_over_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of key and what was withheld, in segments of 300 rows."""
    admitted = sampling.on_change(failures(spark, sf_dir), span=300, keep_segment=True)
    return sampling.with_suppressed(admitted, span=300).select("gate", "seq", "suppressed")


@query(f"{INTERVAL_SQL} SELECT gate, seq, admitted FROM w")
def sample_interval_over_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two records of a kind per hour and gate, in segments of 300 rows with sparse sequence numbers."""
    sparse = failures(spark, sf_dir).withColumn("seq", F.col("seq") * 1_000_000)
    thinned = sampling.per_interval(sparse, dt.timedelta(hours=1), 2, span=300)
    return thinned.select("gate", (F.col("seq") / 1_000_000).cast("bigint").alias("seq"), "admitted")
