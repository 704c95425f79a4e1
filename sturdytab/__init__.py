"""Data quality, seeded corruption and robust model choice for labelled tables on Spark."""

from sturdytab.table import LabelledTable

__all__ = ["LabelledTable"]
