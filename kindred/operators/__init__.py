"""Relational operators of the linkage engine; all take and return lazy DataFrames."""
