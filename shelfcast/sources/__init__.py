"""Readers of ERP exports and table writers."""
