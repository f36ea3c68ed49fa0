"""Spark-native analytics for company filings, facts, prices, estimates and processing logs."""
