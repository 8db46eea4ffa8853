"""lumisift: a Spark-first engine for curating large image collections."""

__version__ = "0.1.0"
