"""Readers and writers: office files, HTML, text, archives, CSV and Markdown."""
