"""Operators over records, actors, labels and activity. All take and return DataFrames."""
