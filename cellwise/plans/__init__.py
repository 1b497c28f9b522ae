"""Plans of cellwise."""
