"""Training-data operators: ten self-contained operators and their queries."""
