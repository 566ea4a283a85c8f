"""Reconciliation and coverage analytics over evidence records, for Spark."""
