"""Order-event analytics on Spark DataFrames.

Raw order-event files become typed DataFrames (``sources``); row-level labels
are Column expressions (``functions``); order versions and order lives are
DataFrame transforms (``operators``); the market, lifecycle and repricing
questions are built from those (``plans``).
"""
