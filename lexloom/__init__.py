"""Corpus, lexicography and run-bookkeeping operators as DataFrame transformations."""
