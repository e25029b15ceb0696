"""Readers, writers and the mapping of the supplied tables to sales lines."""
