"""Rolling forecast attribution on Spark."""
