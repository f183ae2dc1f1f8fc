"""Jobs that are run from the command line; each does its work in a function that takes a session."""
