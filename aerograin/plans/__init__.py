"""Registered queries of the analytics operators, with equivalent SQL."""
