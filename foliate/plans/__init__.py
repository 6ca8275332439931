"""Whole queries over the tables of a folder, and the helpers they share."""
