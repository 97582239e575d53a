"""timelinekit - text and timeline analytics as plain PySpark DataFrame operators."""
