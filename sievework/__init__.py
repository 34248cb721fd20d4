"""sievework: record screening, retrieval, evaluation and corpus curation on Spark DataFrames."""
