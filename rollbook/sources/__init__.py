"""Readers and writers: entity tables, files, drafts, backups, versioned sinks."""
