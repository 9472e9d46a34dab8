"""Operators for training-data pipelines at large scale.

Nothing else in the package imports this one.  ``queries()`` and ``oracle_sql()`` list
one query per operator for the driver.
"""
