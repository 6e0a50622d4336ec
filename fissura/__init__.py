"""Surface-crack image analysis as Spark jobs."""
