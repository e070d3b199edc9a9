"""Operators for preparing training data: thirteen methods over documents, vectors and conversations."""
