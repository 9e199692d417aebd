"""Spatio-temporal analytics over sensor panels and graphs, written as Spark jobs."""
