"""Functions of the detection and protection library."""
