"""rosterkit: roster and catalogue data operators as Spark DataFrame jobs."""

__version__ = "0.1.0"
