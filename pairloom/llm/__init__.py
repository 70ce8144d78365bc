"""Training-data operators.  Nothing else in the library imports this
subpackage; its queries are registered only where it is present."""
