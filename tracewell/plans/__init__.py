"""Jobs, route plans and the command line."""
