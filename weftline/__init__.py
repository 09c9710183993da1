"""Sparse join-aggregate analytics on Spark.

A matrix is a DataFrame of coordinates ``(i, j, v)``. The sparse product is a join and a
grouped sum; how its unreduced rows fall into equal blocks is itself a set of queries.
"""
