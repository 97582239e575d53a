"""Readers and writers: registries, feeds, transcripts, series, media files, markup, notes."""
