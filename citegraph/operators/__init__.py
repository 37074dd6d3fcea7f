"""DataFrame -> DataFrame operators over the publication graph."""
