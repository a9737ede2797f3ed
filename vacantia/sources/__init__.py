"""Search plans and readers of landed source data."""
