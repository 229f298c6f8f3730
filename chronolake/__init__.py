"""chronolake: leakage-safe temporal analytics as PySpark DataFrame operators."""
