"""Whole plans over the operators, and the registered queries."""
