"""Whole plans made of the operators, and the registered queries."""
