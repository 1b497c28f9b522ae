"""Functions of cellwise."""
