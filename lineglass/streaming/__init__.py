"""The line rules over arriving files."""
