"""Information-theoretic two-way clustering of ordered text and numeric data, on Spark."""
