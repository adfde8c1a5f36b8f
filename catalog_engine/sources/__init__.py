"""Readers and writers of the files that the operators work on."""
