"""Runnable jobs: each has a command line (python -m jobs.NAME CONFIG) and a function that takes a session."""
