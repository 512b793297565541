"""lumentrack: a PySpark-native engine for video annotation analytics.

Functions take and return DataFrames; thresholds are explicit options; nothing
keeps global state and nothing collects an unbounded result to the driver.
"""
