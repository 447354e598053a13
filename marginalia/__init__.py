"""Review-comment analytics over word-processor archives, on Spark."""
