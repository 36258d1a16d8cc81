"""Streaming versions of the checks that run as invoices arrive."""
