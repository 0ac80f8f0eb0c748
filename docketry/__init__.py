"""Expense-document analytics on Spark: extraction, reconciliation, duplicate claims, evaluation."""
