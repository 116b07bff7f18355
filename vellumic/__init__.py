"""vellumic: a Spark-first engine for document analytics and hybrid retrieval."""
