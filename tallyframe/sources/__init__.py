"""Sources: statement files (CSV, xlsx), stored tables, derived inputs."""
