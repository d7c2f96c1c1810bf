"""folioscope: document-layout analytics on Spark DataFrames."""
