"""Compositions of the operators into whole analyses."""
