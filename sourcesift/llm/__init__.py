"""Operators of a training-data pipeline: de-duplication, counting, mixing, sharding and archives."""
