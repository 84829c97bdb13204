"""Settings, retry, plan inspection and the query catalogue."""
