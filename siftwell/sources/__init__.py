"""Sources, sinks and the relations derived from the tables."""
