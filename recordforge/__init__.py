"""Record quality and corpus preparation as Spark DataFrame operators."""
