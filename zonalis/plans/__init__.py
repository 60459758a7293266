"""Field requests, batch jobs and the registered query catalogue."""
