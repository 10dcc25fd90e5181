"""Web-traffic analytics on Spark DataFrames: parsing, rule lanes, key streams, change scores, alerts, interval logs."""
