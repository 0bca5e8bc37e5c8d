"""tarn: a Spark-first engine for code and document intelligence."""
