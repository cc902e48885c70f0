"""Operators on DataFrames: joins in time, alerts, trends, indicators, model evaluation."""
