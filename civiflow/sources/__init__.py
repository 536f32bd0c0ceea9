"""Readers, extract selection and sinks."""
