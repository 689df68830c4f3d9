"""Operators of a large-scale training-data pipeline.

Nothing else in the package imports this subpackage.  Every operator takes a
DataFrame and the names of the columns it needs, selects only those columns
(extra columns never clash) and returns a new DataFrame.
"""
