"""Readers and writers of the formats that transcripts come in."""
