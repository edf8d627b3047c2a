"""Readers, sinks and the tables that the queries run on."""
