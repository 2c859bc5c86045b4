"""Readers and adapters that give relations."""
