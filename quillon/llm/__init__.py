"""Operators of a training-data pipeline.

Each module holds one operator with a general DataFrame interface; ``queries``
applies them to the standard tables.  Nothing outside this folder imports it.
"""
