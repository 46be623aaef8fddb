"""DataFrame operators over element histories, changesets and tiles."""
