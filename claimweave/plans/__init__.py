"""Queries: their form, validation, JSON, and their translation to DataFrame plans."""
