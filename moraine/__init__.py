"""Moraine: analytics over content-addressed snapshot stores, as PySpark DataFrame operators."""
