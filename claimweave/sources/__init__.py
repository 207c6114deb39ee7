"""Readers and writers of claim tables."""
