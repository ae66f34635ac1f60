"""Readers and writers of chat exports, markdown and event buffers."""
