"""Part of redactlake."""
