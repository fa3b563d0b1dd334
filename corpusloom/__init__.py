"""corpusloom: duplicate detection, ranking and corpus preparation as Spark jobs."""
