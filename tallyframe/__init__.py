"""tallyframe: statement ingestion, rule categorization and shared-expense
analytics written as Spark DataFrame transformations.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a function
returning a Column) so callers chain them with ``df.transform(...)`` and let
Catalyst plan the whole pipeline at once.
"""

__version__ = "0.1.0"
