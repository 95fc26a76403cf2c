"""Whole plans: the batch apply and the registered queries."""
