"""Runnable jobs over the library's operators. Each has a function that takes a session, a config file and a command line."""
