"""depotlens: storage-inventory analytics written for Spark."""
