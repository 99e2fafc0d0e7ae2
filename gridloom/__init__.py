"""Spreadsheet-shaped analytics on PySpark: typed sparse cells, windows, formulas, formats, diffs."""

__version__ = "0.1.0"
