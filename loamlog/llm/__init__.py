"""Operators of a training-data pipeline: scoring, filtering, deduplication, packing, sharding.

Nothing outside this folder imports it; ``registry`` lists its queries and ``oracles`` their
SQL twins. Every operator takes DataFrames and column names, uses private names inside (so
extra columns cannot clash) and states what it does with nulls, empty texts and repeated rows.
"""
