"""Spark jobs for forecasting the daily sales of many stores, and for preparing training text."""
