"""Compositions of the operators: the daily run, the marts and the measures over them."""
