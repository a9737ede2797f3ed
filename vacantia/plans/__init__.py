"""Stored state, runs and exports."""
