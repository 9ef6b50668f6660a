"""Whole analyses, the query catalogue and its oracle SQL."""
