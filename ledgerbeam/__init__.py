"""Ledger analytics for accounting dashboards, written as Spark DataFrame plans."""
