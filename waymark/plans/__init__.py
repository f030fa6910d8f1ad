"""Plan assembly, reports and the command line."""
