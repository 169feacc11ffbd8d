"""locusframe: relational operators for genomics tables on Spark DataFrames."""
