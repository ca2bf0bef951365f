"""grovelens: source trees, their documentation and large text corpora as Spark DataFrames."""
