"""Training-data operators for very large text corpora.  Nothing else in the package imports this."""
