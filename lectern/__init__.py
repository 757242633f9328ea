"""lectern: retrieval-conditional evaluation of text corpora on Spark DataFrames."""
