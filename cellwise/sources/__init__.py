"""Sources of cellwise."""
