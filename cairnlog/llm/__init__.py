"""Operators of a training-data pipeline: cleaning, deduplication, tokens and packing.

``queries`` registers one query per operator; nothing else in the library imports this
subpackage.
"""
