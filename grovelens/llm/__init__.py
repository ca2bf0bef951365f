"""Operators of a training-data pipeline. Nothing else in grovelens imports this subpackage."""
