"""Readers, backends for images and PDF, and sinks."""
