"""watchwell: sign-in log analytics as PySpark DataFrame operators."""
