"""Program analysis and findings at fleet scale, as Spark DataFrames."""
