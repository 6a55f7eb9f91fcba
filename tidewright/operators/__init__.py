"""Operators from DataFrame to DataFrame; each module takes one subject."""
