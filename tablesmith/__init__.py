"""Document-table analytics on PySpark: every operator takes and returns DataFrames."""
