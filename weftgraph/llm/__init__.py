"""Operators of a training-data pipeline over source code and texts. Nothing outside this folder imports it."""
