"""Training-data operators: one module for each, and their queries in ``queries``."""
