"""Relational operators over records, chunks, edges, events and rankings."""
