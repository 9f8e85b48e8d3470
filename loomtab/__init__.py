"""loomtab: tabular analytics, synthesis and audit operators on PySpark."""

__version__ = "0.1.0"
