"""Accounts-payable operators: plain functions from DataFrames to DataFrames."""
