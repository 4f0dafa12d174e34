"""Readers and writers of archives, media and documents."""
