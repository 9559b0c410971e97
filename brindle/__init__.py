"""A push-down query engine on Spark: typed scans, versioned tables, ordered keys, change feeds."""
