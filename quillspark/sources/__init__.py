"""Readers and writers: corpora, transcripts, candidates, preferences, reports, snapshots."""
