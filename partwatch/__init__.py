"""Software-inventory risk analytics as Spark DataFrame jobs."""
