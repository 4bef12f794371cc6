"""Tidemark: ledger analytics and data processing as composable Spark DataFrame operators."""
