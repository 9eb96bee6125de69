"""Analytics of recordings on Spark: annotation tables, gridded signals, labels and their statistics."""
