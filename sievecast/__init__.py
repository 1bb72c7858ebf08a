"""Analytics over text, source code and their diagnostics, on Spark."""
