"""Jobs that are run over and over: each has a command line and a file of settings."""
