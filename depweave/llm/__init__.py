"""Operators for training-data pipelines: licences, secrets, mixing, copies, search, scoring and tokens."""
