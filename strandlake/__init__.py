"""strandlake: alignment-free sequence classification and corpus preparation on Spark."""
