"""Relational operators over postings, history and run ledgers."""
