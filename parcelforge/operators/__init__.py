"""Plan-level operators: DataFrame in, DataFrame out."""
