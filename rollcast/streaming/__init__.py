"""Series from event streams."""
