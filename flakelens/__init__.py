"""Flaky-test triage and repair-attempt analytics as PySpark DataFrame operators."""
