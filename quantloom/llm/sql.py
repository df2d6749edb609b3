"""DuckDB SQL of the queries that SQL can express."""

SQL = {
    "p5_found": """
WITH candles AS (
  SELECT symbol, ts::TIMESTAMP AS ts, min(candle_id) AS candle_id FROM candles_1m
  WHERE ts IS NOT NULL AND "close" IS NOT NULL AND "close"::VARCHAR <> 'nan' GROUP BY ALL
), records AS (
  SELECT trade_id AS record_id, asset AS symbol, entry_time::TIMESTAMP AS ts, row_number() OVER (PARTITION BY trade_id ORDER BY saved_at DESC) AS n FROM trades
  UNION ALL
  SELECT snapshot_id, underlying, snapshot_time::TIMESTAMP, row_number() OVER (PARTITION BY snapshot_id ORDER BY arrived_at DESC) FROM options_oi_snapshot
), r AS (SELECT * FROM records WHERE n = 1 AND ts IS NOT NULL AND symbol IS NOT NULL),
near AS (
  SELECT record_id, candle_id, abs(epoch_us(r.ts) - epoch_us(c.ts)) AS gap, c.ts
  FROM r JOIN candles c ON r.symbol = c.symbol AND c.ts BETWEEN r.ts - INTERVAL 90 SECOND AND r.ts + INTERVAL 90 SECOND
)
SELECT record_id, arg_min(candle_id, struct_pack(g := gap, t := ts)) AS candle_id FROM near GROUP BY record_id
""",
}
