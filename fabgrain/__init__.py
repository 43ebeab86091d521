"""Die-level measurement analytics as parameterised Spark DataFrame operators."""
