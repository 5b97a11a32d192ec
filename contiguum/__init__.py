"""Assembly-graph analytics on Spark."""
