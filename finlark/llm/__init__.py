"""Operators of a training-data pipeline: one module each, plus ``queries``."""
