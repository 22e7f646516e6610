"""Whole runs: the scoring patterns, their run log, and the reports over it."""
