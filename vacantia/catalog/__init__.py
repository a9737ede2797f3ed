"""Registered queries over the given tables, each with SQL that must give the same rows."""
