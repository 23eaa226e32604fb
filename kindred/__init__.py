"""Record linkage on PySpark DataFrames."""
