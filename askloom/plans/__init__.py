"""Shared plan shapes: size checks, numbering of long groups, scratch tables."""
