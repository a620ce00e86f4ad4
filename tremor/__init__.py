"""tremor: event-driven exposure analysis as PySpark DataFrame operators."""
