"""Training-data operators: filtering, search, packing, encoding and scoring of large corpora."""
