"""Governance analytics as Spark DataFrame operators."""
