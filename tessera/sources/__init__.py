"""Readers and writers: files with checked headers, company seeds, and a paged REST source."""
