"""Signal robustness analytics on Spark."""
