"""Part of vecmill."""
