"""Compositions of operators: the whole way from facts to an index."""
