"""Driver tables, landing-directory reads and file sinks."""
