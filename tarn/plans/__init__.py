"""Whole flows over the operators, their command lines, and the registered queries."""
