"""Memory operators: DataFrame in, DataFrame out."""
