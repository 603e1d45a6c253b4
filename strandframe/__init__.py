"""strandframe: DataFrame operators for genomics-style tables on Apache Spark."""
