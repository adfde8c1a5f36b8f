"""Compositions, domain tables and the registered queries."""
