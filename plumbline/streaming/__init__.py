"""No operator of the surveyed pipeline works on streams, so this package is empty on purpose."""
