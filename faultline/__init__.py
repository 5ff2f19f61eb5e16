"""Vehicle-defect analytics as Spark DataFrame jobs."""
