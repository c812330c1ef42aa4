"""Joins, aggregations, rankings and matching over the domain tables."""
