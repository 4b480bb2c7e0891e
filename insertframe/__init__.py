"""insertframe: construct verification and corpus preparation on PySpark DataFrames."""
