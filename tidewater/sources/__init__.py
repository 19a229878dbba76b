"""Feeds as typed rows with a reject side, and the tables they are kept in."""
