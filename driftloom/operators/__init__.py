"""Relational and analytic operators over states, windows and scores."""
