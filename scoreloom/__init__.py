"""scoreloom: batch model scoring over file collections and tables, as Spark jobs."""

__version__ = "0.1.0"
