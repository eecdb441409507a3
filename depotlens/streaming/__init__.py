"""Progress of running scans as streams (see ``progress``)."""
