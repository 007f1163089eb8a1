"""Wardrobe and engagement analytics as lazy PySpark DataFrame operators.

Every operator takes DataFrames plus an explicit ``as_of`` and answers for all
users at once: ``user_id`` is the leading key of each join and aggregation.
"""
