"""Operators over series: alignment, rolling scores, nulls, forecasts, reports."""
