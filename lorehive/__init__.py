"""lorehive: document knowledge-base jobs over whole corpora, as Spark DataFrames."""
