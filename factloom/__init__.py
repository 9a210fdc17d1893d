"""factloom: facts, text corpora and dependency graphs analysed with Spark DataFrames."""
