"""Readers and writers for the table and Newick layouts."""
