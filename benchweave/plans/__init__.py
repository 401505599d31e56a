"""Registered queries: each pairs operator calls with the plain SQL that checks them."""
