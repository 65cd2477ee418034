"""Operators for text corpora: packing, leakage of test items, repair of garbled text.  Nothing outside imports this."""
