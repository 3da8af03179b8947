"""Multi-tenant event analytics on Spark: plain DataFrame -> DataFrame operators."""
