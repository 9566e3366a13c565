"""quirework: document analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame``; Catalyst plans the
work, and Arrow functions appear only where an algorithm is sequential or
numeric.  ``quirework.llm`` holds the training-text operators and is optional:
nothing outside that subpackage imports it.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
