"""Order-flow analytics on Spark."""
