"""Point-in-time equity research on Spark: every operator is DataFrame in, DataFrame out."""
