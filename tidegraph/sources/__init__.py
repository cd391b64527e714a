"""Readers: command files and streams, saved graphs, social messages."""
