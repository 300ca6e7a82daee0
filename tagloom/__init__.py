"""Text segmentation on Spark: clean, index, train, classify, rank and evaluate as DataFrame jobs."""
