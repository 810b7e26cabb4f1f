"""Operators for training text: encoding, packing and splitting by tokens.

Nothing outside this subpackage imports it.
"""
