"""Moderation-signal analytics on Spark DataFrames.

Every operator takes DataFrames and parameters and returns a lazy DataFrame. Only the writers in ``sources`` run
jobs, and ``joins.broadcast_checked``, which counts a small table before it is broadcast.
"""
