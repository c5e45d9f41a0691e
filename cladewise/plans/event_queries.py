"""Queries over the event table: sessions are to users what runs of windows are to pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import sessions as S
from .relation_queries import rounded
from .views import oracle, view

QUERIES, ORACLE = {}, {}

QUERIES["event_sessions"] = lambda s, d: rounded(S.sessions(view(s, d, "events"), "6 hours"), "total", digits=6).select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', start)").alias("start_us"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `end`)").alias("end_us"), "n", "total")
ORACLE["event_sessions"] = oracle("""WITH e AS (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS us, value FROM events), m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS new FROM e),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n, round(sum(value), 6) AS total FROM r GROUP BY user_id, run""")
