"""Compositions of operators: instances, clients, models, and the registered queries."""
