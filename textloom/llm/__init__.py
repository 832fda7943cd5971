"""Training-data operators: ten jobs over the documents table, each in a module of its own."""
