"""Generic DataFrame-to-DataFrame operators."""
