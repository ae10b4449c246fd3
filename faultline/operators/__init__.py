"""Operators: data quality, risk, alerts, geography, linking, graphs and models."""
