"""Finding, judging and protecting sensitive values in large text datasets with Spark."""
