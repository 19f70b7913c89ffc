"""Training-data operators; nothing else in brooklog imports this subpackage."""
