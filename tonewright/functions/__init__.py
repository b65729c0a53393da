"""Column expressions and fixed values. Nothing here triggers a Spark job."""
