"""aerograin: sensor-series analytics and corpus preparation on Spark DataFrames."""
