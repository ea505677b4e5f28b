"""tidewave: a PySpark-native analytics engine for time series, signals, load records and tracking data."""
