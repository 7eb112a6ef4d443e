"""Lifecycles over streams of facts (an extension of the batch operators)."""
