"""Spark-first change-impact analytics: change plans, facts, evidence, graphs and nested records."""
