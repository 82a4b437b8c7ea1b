"""Operators a training-data pipeline needs: near copies, leaks, scores, personal data, search, mixing.

Nothing else in the package imports this one.  Every operator is ``DataFrame -> DataFrame``
and takes the names of its columns; ``queries`` holds the thin registered queries.
"""
