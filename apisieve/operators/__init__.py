"""Relational operators over facts, evidence and findings."""
