"""Spark-native analytics for intraday market data: bars, books, regimes, trades and their upkeep at scale."""
