"""Readers: trace files, file catalogues, compiler logs and compatibility maps."""
