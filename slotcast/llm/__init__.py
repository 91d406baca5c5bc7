"""Operators for training-data pipelines on the tables documents, pages, benchmark and labels."""
