"""Cubes over dimensions with weighted consolidations, rules, MDX and write-back on Spark."""
