"""fieldloom: form-mapping analytics and corpus preparation as Spark DataFrame jobs."""
