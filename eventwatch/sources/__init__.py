"""Readers and writers of event, alert, audit and catalogue tables."""
