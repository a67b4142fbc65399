"""Grid-based geospatial analytics written as Spark DataFrame jobs."""
