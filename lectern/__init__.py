"""lectern: evaluation-data curation, checking and scoring on Spark DataFrames."""
