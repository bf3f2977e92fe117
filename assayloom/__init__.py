"""Assayloom: statistics over long sample-by-feature tables, written for Spark."""
