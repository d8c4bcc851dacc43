"""Ledgerspark: bill cleaning, reconciliation and review as Spark DataFrame operators."""
