"""DataFrame -> DataFrame operators of the scan."""
