"""Operators of a training-data pipeline; nothing else in flowlens imports this subpackage."""
