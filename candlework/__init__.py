"""candlework: market-research analytics on ordered bar and observation tables.

Every operator is a function from DataFrame to DataFrame.  Series keys and the
time column are parameters, so one table may hold any number of series.
"""
