"""Registered queries and composite audits."""
