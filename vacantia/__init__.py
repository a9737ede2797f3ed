"""Vacantia: collect, clean, de-duplicate, score and report job offers with Spark."""
