"""Anonymizing streams: the same column expressions over ``readStream``."""
