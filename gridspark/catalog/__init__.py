"""Registered jobs: each one is a library job over canonical views of the given tables, with its SQL check."""
