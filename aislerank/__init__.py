"""Product-catalogue analytics and ranking as PySpark DataFrame jobs."""
