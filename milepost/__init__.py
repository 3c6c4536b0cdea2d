"""milepost: route-and-measure event analytics as lazy Spark DataFrames."""
