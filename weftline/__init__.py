"""weftline: evidence retrieval and typed property-graph analytics on Spark."""
