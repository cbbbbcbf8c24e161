"""plexmat: PySpark-native analytics for collections of sparse measurement matrices."""

__version__ = "0.1.0"
