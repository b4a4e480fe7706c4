"""Marketplace analytics as Spark DataFrame operators."""
