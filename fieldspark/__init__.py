"""Field and irrigation analytics as Spark jobs: DataFrames in, DataFrames out."""
