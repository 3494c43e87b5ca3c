"""Writers that take a sink's rows."""
