"""tallyport: content-addressed artifact stores, and text corpora, as Spark DataFrames."""
