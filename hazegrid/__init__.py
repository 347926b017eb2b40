"""hazegrid: lazy PySpark operators for networks of air-quality stations."""

__version__ = "0.1.0"
