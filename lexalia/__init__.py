"""Corpus analytics on PySpark: documents, names, dates, terms, topics, networks.

Every public operator takes and returns DataFrames (or Columns); nothing runs
until the caller asks for rows, except where an iterative operator says so.
"""

from lexalia.session import build_session

__all__ = ["build_session"]
