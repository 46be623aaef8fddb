"""Readers of the file formats and of sequence-numbered change feeds."""
