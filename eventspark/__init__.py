"""eventspark: longitudinal event-data pipelines as single lazy Spark plans."""

__version__ = "0.1.0"
