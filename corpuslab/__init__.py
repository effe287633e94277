"""corpuslab: build, split, audit and evaluate labelled text corpora on Spark."""
