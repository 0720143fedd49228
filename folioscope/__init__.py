"""folioscope: document-quality analytics on Spark DataFrames."""
