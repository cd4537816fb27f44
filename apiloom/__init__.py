"""Static-analysis knowledge graphs of web-service code, and training-data operators, as Spark jobs."""
