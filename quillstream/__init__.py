"""quillstream: a PySpark-native engine for content-flow analytics.

Everything is expressed as ``DataFrame -> DataFrame`` operators and
``Column -> Column`` functions; Catalyst chooses the physical plan.
"""

__version__ = "0.1.0"
